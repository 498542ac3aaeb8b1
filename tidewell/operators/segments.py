"""Transcripts: validating payloads, stitching, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Types of the numbers that JSON holds, as Spark names them.
NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\))$"


def kind(value: Column, shown: Column | None = None) -> Column:
    """number, string, boolean, list, object, null or absent, of a VARIANT; `shown` is its schema_of_variant where that is at hand."""
    name = F.schema_of_variant(value) if shown is None else shown
    return (
        F.when(name.isNull(), "absent").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "object").when(name.rlike(NUMBERS), "number").otherwise("object")
    )


def field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def number_status(value: Column) -> Column:
    """ok, or why a VARIANT is no finite non-negative number; booleans and numeric strings are none."""
    as_double = F.try_variant_get(value, "$", "double")
    return F.when(kind(value) != "number", "not_a_number").when(F.isnan(as_double) | (as_double < 0) | (as_double == float("inf")), "out_of_range").otherwise("ok")


def validate(payloads: DataFrame, key: str, column: str, duration: str | None = None) -> DataFrame:
    """(key, status, text, segments) of JSON payloads.

    A payload is an object with `segments`, a list of {text, start_s, end_s?}, or else with a
    text of its own, which becomes one segment from 0 to the duration.  A text beside
    segments overrides their joined texts.  `status` is ok or names the first fault; faulty
    payloads have null text and segments.
    """
    v = F.col("v")
    parsed = payloads.select(F.col(key), F.try_parse_json(F.col(column)).alias("v"), (F.col(duration) if duration else F.lit(None)).cast("double").alias("duration"))
    own = tx.blank_to_null(F.when(kind(field(v, "$.text")) == "string", F.try_variant_get(v, "$.text", "string")))
    parts = F.try_variant_get(v, "$.segments", "array<variant>")

    def one(part: Column, i: Column) -> Column:
        said = tx.blank_to_null(F.when(kind(field(part, "$.text")) == "string", F.try_variant_get(part, "$.text", "string")))
        start, end = field(part, "$.start_s"), field(part, "$.end_s")
        from_, to = F.try_variant_get(part, "$.start_s", "double"), F.try_variant_get(part, "$.end_s", "double")
        no_end = kind(end).isin("absent", "null")
        fault = (
            F.when(kind(part) != "object", "segment_not_object").when(said.isNull(), "segment_text").when(number_status(start) != "ok", F.concat(F.lit("start_"), number_status(start)))
            .when(~no_end & (number_status(end) != "ok"), F.concat(F.lit("end_"), number_status(end))).when(~no_end & (to < from_), "end_before_start")
        )
        return F.struct(fault.alias("fault"), F.struct(i.cast("int").alias("id"), from_.alias("start_s"), F.when(~no_end, to).alias("end_s"), said.alias("text"), F.lit("local_command").alias("source")).alias("segment"))

    listed = kind(field(v, "$.segments"))
    whole = F.array(F.struct(F.lit(0).alias("id"), F.lit(0.0).alias("start_s"), F.col("duration").alias("end_s"), F.col("own").alias("text"), F.lit("local_command_text").alias("source")))
    staged = parsed.select(key, "v", "duration", own.alias("own"), listed.alias("listed"), F.transform(parts, one).alias("parts"))
    status = (
        F.when(F.col("v").isNull(), "not_json").when(kind(F.col("v")) != "object", "not_object")
        .when(F.col("listed").isin("absent", "null"), F.when(F.col("own").isNull(), "no_text").otherwise("ok"))
        .when(F.col("listed") != "list", "segments_not_list").when(F.size("parts") == 0, "no_segments")
        .otherwise(F.coalesce(F.get(F.filter(F.transform("parts", lambda p: p["fault"]), lambda x: x.isNotNull()), F.lit(0)), F.lit("ok")))
    )
    checked = staged.withColumn("status", status)
    segments = F.when(F.col("listed").isin("absent", "null"), whole).otherwise(F.transform("parts", lambda p: p["segment"]))
    joined = F.when(F.col("own").isNotNull(), F.col("own")).otherwise(F.array_join(F.transform(segments, lambda s: s["text"]), "\n"))
    good = F.col("status") == "ok"
    return checked.select(key, "status", F.when(good, joined).alias("text"), F.when(good, segments).alias("segments"))


def stitch(segments: DataFrame, key: str, order: str, text: str, joint: str = "\n") -> DataFrame:
    """(key, text): the key's texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return segments.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s[text]), joint).alias("text"))


def summarise(segments: DataFrame, key: str) -> DataFrame:
    """(key, words, summary) from segments (id, start_s, text): anchor and lead of the first, words of all."""
    first = F.min(F.struct("id", "start_s", "text"))
    each = segments.groupBy(key).agg(first.alias("first"), F.sum(tx.word_count("text")).alias("words"))
    return each.select(key, "words", tx.summary(F.col("first.text"), F.col("first.start_s"), F.col("words")).alias("summary"))


def from_sidecars(media: DataFrame, sidecars: DataFrame, name: str = "relative_path") -> DataFrame:
    """Media joined to the sidecar of their stem, with `status` and the stripped `text`.

    `sidecars` has the name and binary `content`; media that share a stem share the sidecar.
    """
    side = sidecars.select(F.col(name).alias("sidecar"), F.try_validate_utf8(F.col("content").cast("string")).alias("raw"), F.sha2("content", 256).alias("raw_sha256"), F.lit(True).alias("found"))
    joined = media.withColumn("sidecar", tx.sidecar_name(name)).join(side, "sidecar", "left")
    text = tx.blank_to_null("raw")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("raw").isNull(), "not_utf8").when(text.isNull(), "empty").otherwise("ok")
    return joined.select(*media.columns, status.alias("status"), text.alias("text"), "raw_sha256")

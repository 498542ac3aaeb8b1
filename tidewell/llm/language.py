"""Language identification by fusing text likelihoods, declared languages and smoothed host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, joinable, map_arrow, own_names, table
from .hashing import pieces, strings

#: Bytes for scoring: letters lower-cased, non-ASCII as it is, all else a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
BITS = 16
#: Log-likelihood of a trigram that no language explains.
UNKNOWN = -10.0
#: Trigrams overlap, so three of them count as one; beyond this many a text can't become surer.
OVERLAP, ENOUGH = 3.0, 300


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around each letter, and for each row the first one's place; rows don't run into each other."""
    n = len(data)
    folded = np.full(n + 2, 32, np.uint8)
    folded[1:-1] = FOLD[data]
    left, right = folded[:-2].copy(), folded[2:].copy()
    left[offsets[:-1][offsets[:-1] < n]] = 32
    right[offsets[1:][offsets[1:] > 0] - 1] = 32
    at = np.flatnonzero(folded[1:-1] != 32)
    code = (left[at].astype(np.uint32) << 16) | (folded[1:-1][at].astype(np.uint32) << 8) | right[at]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), np.searchsorted(at, offsets)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  #: log-likelihoods, a row for each language


def fit(rows: DataFrame, text_col: str, label_col: str, per_language: int = 400, sample_chars: int = 50_000, long_texts: int = 4) -> Model:
    """A naive Bayes trigram model of every label from at most `per_language` of its whole texts of up to `sample_chars` characters.

    A label all of whose texts are longer is learned from up to `long_texts` of those.  The sample is of different texts,
    drawn by their hash: only hashes are counted and ranked, so copies of a text count once and gather nowhere, and about
    twice the wanted hashes of each label are let through.  It bounds only the classifier.  Trigrams are counted where the
    texts are; their sums, at most 65,536 a label, reach the driver.  Null texts and labels are left out.
    """
    given = own_names(rows, text=text_col, label=label_col).where("text is not null and label is not null")
    given = given.select("label", "text", (F.length("text") > sample_chars).alias("long"), F.xxhash64("text").alias("place"))
    kinds = table(given.groupBy("label", "place").agg(F.min("long").alias("long")), "kinds")
    counts = kinds.groupBy("label").agg(F.count_if(~F.col("long")).alias("short"), F.count("*").alias("n"))
    wanted = F.when(F.col("short") > 0, F.lit(per_language)).otherwise(long_texts)
    share = F.least(F.lit(1.0), 2 * wanted / F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("n")))
    draw = table(counts.select("label", (F.col("short") > 0).alias("any_short"), wanted.alias("wanted"), share.alias("share")), "labels")
    drawn = kinds.join(joinable(draw), "label").where("long <> any_short").where(F.shiftrightunsigned("place", 33) <= F.col("share") * float(1 << 31))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("place"))
    drawn = table(drawn.withColumn("rank", rank).where("rank <= wanted").select("label", "place"), "drawn")
    # one text of each hash: tasks send on one copy at most
    sampled = given.join(joinable(drawn), ["label", "place"]).groupBy("label", "place").agg(F.min("text").alias("text")).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                code, n = np.unique(trigrams(*strings(pa.array([text.as_py()], pa.string())))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(n.astype(np.int64))], ["label", "code", "n"])

    sums = map_arrow(sampled, count, "label string, code int, n long").groupBy("label", "code").agg(F.sum("n").alias("n")).toPandas()
    drop_table(kinds, draw, drawn)
    found = {}
    for label, own in sums.groupby("label", sort=True):
        held = np.full(1 << BITS, 0.05)
        held[own["code"].to_numpy()] += own["n"].to_numpy()
        found[label] = np.log(held / held.sum())
    return Model(tuple(found), np.stack(list(found.values())).astype(np.float32) if found else np.zeros((0, 1 << BITS), np.float32))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` (id, text, declared, host, suffix) without text, with `grams` and `ll`: log-likelihoods of each language, unknown last."""
    sent = rows.sparkSession.sparkContext.broadcast(model.table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in pieces(offsets):
                grams, first = trigrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.diff(first)
                sums = [np.diff(np.concatenate([[0.0], np.cumsum(w[grams], dtype=np.float64)])[first]) for w in weights]
                ll = np.stack([*sums, UNKNOWN * n], 1) * (np.minimum(n, ENOUGH) / np.maximum(n, 1) / OVERLAP)[:, None]
                listed = pa.FixedSizeListArray.from_arrays(pa.array(ll.ravel()), ll.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(batch.column(i).slice(lo, hi - lo) for i in (2, 3, 4)), pa.array(n, pa.int64()), listed], ["id", "declared", "host", "suffix", "grams", "ll"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows.select("id", "text", "declared", "host", "suffix"), run, f"id {kind}, declared string, host string, suffix string, grams long, ll array<double>")


def _normal(logs: Column) -> Column:
    """Probabilities from unnormalised logs."""
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def identify(
    rows: DataFrame, model: Model, id_col: str, text_col: str, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None,
    strength: float = 10.0, sure: float = 0.5,
) -> DataFrame:
    """(id, lang, confidence, text_lang, n_grams, kept) of every row.

    The posterior of a language multiplies
    - the likelihood of the text's trigrams, tempered for their overlap and for length;
    - the probability of the declared language (markup or metadata) given the true one, from
      the contingency of declared and text languages over all rows, smoothed;
    - the prior of the row's host, the expected counts of its other rows shrunk (by `strength`
      rows) to the prior of its address suffix, itself shrunk to that of all rows.
    Counts are grouped sums over all rows; only the label-by-label table and the totals reach
    the driver.  A row's own part is taken out of its host's and suffix's counts.

    `lang` is `und` if no language explains the text better than the unknown model.  A row is
    kept if it has letters, is not `und` and its posterior is at least `sure`.  Null and
    letterless texts are not kept (their `lang` rests on the other evidence).  Null declared
    values, hosts and suffixes are values of their own.  Repeated ids are separate rows; extra
    columns are ignored; an empty table gives no rows.
    """
    names, k = [*model.languages, "und"], len(model.languages) + 1
    none = F.lit(None).cast("string")
    known = lambda c: F.when(c.isNull(), "none").when(c.isin(*model.languages), c).otherwise("other")
    primary = lambda c: F.regexp_extract(F.lower(c), r"^\s*([a-z]+)", 1)  # noqa: E731  en of en-GB
    given = rows.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), known(primary(none if declared is None else declared)).alias("declared"),
        F.coalesce(none if host is None else host, F.lit("")).alias("host"), F.coalesce(none if suffix is None else suffix, F.lit("")).alias("suffix"),
    )
    scored = score(given, model).withColumn("ll", F.when(F.col("grams") > 0, F.col("ll")).otherwise(F.array_repeat(F.lit(0.0), k)))
    scored = table(scored.withColumn("own", F.when(F.col("grams") > 0, _normal(F.col("ll"))).otherwise(F.array_repeat(F.lit(0.0), k))), "scored")
    sums = lambda: F.array(*(F.sum(F.get("own", F.lit(i))) for i in range(k)))
    best = F.array_position("own", F.array_max("own")).cast("int")
    seen = {(r.best, r.declared): r["count"] for r in scored.where("grams > 0").groupBy(best.alias("best"), "declared").count().collect()}
    kinds = [*model.languages, "other", "none"]
    trust = {d: [float(np.log((seen.get((i + 1, d), 0) + 1) / (sum(seen.get((i + 1, x), 0) for x in kinds) + len(kinds)))) for i in range(k)] for d in kinds}
    total = scored.agg(sums()).first()[0] or [0.0] * k
    total = [(x or 0.0) + 1.0 for x in total]
    overall = F.array(*(F.lit(x / sum(total)) for x in total))
    by_host = scored.groupBy("host", "suffix").agg(sums().alias("host_sums"))
    by_suffix = by_host.groupBy("suffix").agg(F.array(*(F.sum(F.get("host_sums", F.lit(i))) for i in range(k))).alias("suffix_sums"))
    counts = table(by_host.join(by_suffix, "suffix"), "hosts")

    def shrunk(held: str, parent: Column) -> Column:
        """Counts without the row's own part, shrunk to the parent's prior."""
        others = F.zip_with(F.col(held), F.col("own"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
        mass = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(others, parent, lambda a, b: (a + strength * b) / (mass + strength))

    prior = scored.join(counts, ["host", "suffix"]).withColumn("parent", shrunk("suffix_sums", overall)).withColumn("prior", shrunk("host_sums", F.col("parent")))
    declared_logs = F.create_map(*(x for d in kinds for x in (F.lit(d), F.array(*map(F.lit, trust[d])))))
    fused = prior.withColumn("logs", F.zip_with(F.zip_with("ll", F.element_at(declared_logs, F.col("declared")), lambda a, b: a + b), "prior", lambda a, b: a + F.log(b)))
    fused = fused.withColumn("posterior", _normal(F.col("logs")))
    label = lambda p: F.get(F.array(*map(F.lit, names)), F.array_position(p, F.array_max(p)).cast("int") - 1)
    out = fused.select("id", label(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), F.when(F.col("grams") > 0, label(F.col("own"))).alias("text_lang"), F.col("grams").alias("n_grams"))
    return out.withColumn("kept", (F.col("n_grams") > 0) & (F.col("lang") != "und") & (F.col("confidence") >= sure))

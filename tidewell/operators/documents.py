"""Manifests: reading, stages and outputs, provenance, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read(spark: SparkSession, root: str) -> DataFrame:
    """All manifest.json files below a folder, with the fixed schema."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(root)


def write(manifests: DataFrame, folder: str) -> None:
    manifests.write.json(folder)


def routed(manifests: DataFrame, version: str = "1.0.0") -> DataFrame:
    """Manifests with `readable`: the same major schema version."""
    major = lambda c: F.split(c, r"\.")[0]
    return manifests.withColumn("readable", F.coalesce(major(F.col("schema_version")) == major(F.lit(version)), F.lit(False)))


def with_all_stages(stages: Column) -> Column:
    """A stage map that holds every stage, pending where nothing is recorded."""
    empty = F.struct(F.lit("pending").alias("state"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.STAGE.fields[1:-2]), F.array().cast("array<struct<path:string,sha256:string,bytes:bigint>>").alias("outputs"), F.lit(None).cast("string").alias("error"))
    entries = [x for name in schemas.STAGES for x in (F.lit(name), F.coalesce(F.try_element_at(stages, F.lit(name)), empty))]
    return F.create_map(*entries)


def outputs(manifests: DataFrame, key: str = "bundle_id") -> DataFrame:
    """A row for each output of each stage, and one with nulls for a stage without any."""
    staged = manifests.select(key, F.explode("stages").alias("stage", "record"))
    return staged.select(key, "stage", F.col("record.state").alias("state"), F.explode_outer("record.outputs").alias("output")).select(key, "stage", "state", "output.path", "output.sha256", "output.bytes")


def with_stage(stages: Column, name: str, record: Column) -> Column:
    """The map with one stage's record replaced."""
    others = F.map_filter(stages, lambda k, _: k != name)
    return F.map_concat(others, F.create_map(F.lit(name), record))


def with_output(outputs: Column, path: str, sha256: Column, size: Column) -> Column:
    """The outputs with one path's digest and size replaced."""
    new = F.struct(F.lit(path).alias("path"), sha256.alias("sha256"), size.alias("bytes"))
    return F.transform(outputs, lambda o: F.when(o["path"] == path, new).otherwise(o))


def posture(document: Column) -> Column:
    """The recorded posture towards remote services, `not_recorded` by default."""
    return F.coalesce(document["transcript"]["remote_services"]["posture"], F.lit("not_recorded"))


def integrity(recorded: DataFrame, actual: DataFrame, key: list[str], digest: str = "sha256") -> DataFrame:
    """Recorded keys with `status`: ok, altered or missing."""
    found = actual.select(*key, F.col(digest).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col(digest) == F.col("found"), "ok").otherwise("altered")
    return recorded.join(found, key, "left").withColumn("status", status).drop("found")

"""The library of finished bundles and who owns them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def claim(claims: DataFrame, bundle: str, order: list[str], owned: DataFrame | None = None) -> DataFrame:
    """`claims` with `outcome`: the first claimant of a bundle completes, a recorded owner refreshes, others fail as duplicates.

    The first claimant is a map-side combined minimum over (order), so a bundle claimed by a
    third of all rows gathers nowhere.  `owned` has the bundle and `owner`, compared with
    the last order column.
    """
    me = order[-1]
    first = claims.groupBy(bundle).agg(F.min(F.struct(*order)).alias("first"))
    joined = claims.join(first, bundle)
    if owned is not None:
        joined = joined.join(owned.select(bundle, "owner"), bundle, "left")
    else:
        joined = joined.withColumn("owner", F.lit(None).cast(claims.schema[me].dataType))
    won = F.col("owner").isNull() & (F.struct(*order) == F.col("first"))
    outcome = F.when(F.col("owner") == F.col(me), "refreshed").when(won, "completed").otherwise("failed")
    return joined.withColumn("outcome", outcome).drop("first", "owner")


def ownership(queue: DataFrame, library: DataFrame) -> DataFrame:
    """Queue entries with `ownership` of the bundle they name: free, owned or conflict."""
    owner = library.select("bundle_id", F.col("queue_item_id").alias("owner"))
    joined = queue.join(owner, "bundle_id", "left")
    return joined.withColumn("ownership", F.when(F.col("owner").isNull(), "free").when(F.col("owner") == F.col("id"), "owned").otherwise("conflict")).drop("owner")


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work whose (queue entry, bundle) is not done yet."""
    return work.join(done.select(*key), key, "left_anti")


def unindexed(manifests: DataFrame, library: DataFrame) -> DataFrame:
    """Manifests of bundles that were written, but that no library row names."""
    return manifests.join(library.select("bundle_id"), "bundle_id", "left_anti")


def with_manifests(library: DataFrame, manifests: DataFrame) -> DataFrame:
    """Library rows with their manifest, null if there is none."""
    others = [c for c in manifests.columns if c != "bundle_id"]
    return library.join(manifests.select("bundle_id", F.struct(*others).alias("manifest")), "bundle_id", "left")


def provenance(queue: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    """One `provenance` structure for each queue entry: what it is, where it came from, what was approved."""
    joined = queue.join(sources.select(F.col("id").alias("source_id"), "kind", "name", "root_path"), "source_id")
    joined = joined.join(items.select(F.col("id").alias("source_item_id"), "relative_path", "sha256"), "source_item_id")
    return joined.select(
        "id",
        F.struct(
            F.struct(F.col("source_id").alias("id"), "kind", "name", "root_path").alias("source"),
            F.struct(F.col("source_item_id").alias("id"), "relative_path", "sha256").alias("item"),
            F.struct(F.col("id"), "policy", "content_sha256").alias("queue"),
        ).alias("provenance"),
    )


def counts(**relations: DataFrame) -> DataFrame:
    """(relation, n) of the given tables."""
    out = None
    for name, rows in sorted(relations.items()):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.union(one)
    return out


def newest(rows: DataFrame, within: list[str], *order) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where("_rank = 1").drop("_rank")

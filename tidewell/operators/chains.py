"""Chains of pages that each name the page before: walked to the first page of interest, all chains at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared


def walk(pages: DataFrame, starts: DataFrame, chain: str, cursor: str, before: str, matches: Column, most: int = 1 << 40) -> DataFrame:
    """(chain, status, cursor, n_read) for each start (chain, cursor): what reading backwards page by page leads to.

    Reading stops at the first page that `matches` (found), at a page with no `before`
    (exhausted), before a cursor that no page has (missing), and is never done on a ring
    without a match (endless); `cursor` is where it stopped, `n_read` the pages read until then,
    and beyond `most` pages the status is limit.  Of pages with one cursor any that matches
    counts, and the least `before`.  Starts that repeat count once; null chains are one chain.

    Every page points to where reading from it leads; pointers are doubled in rounds, so a chain
    of n pages takes log2(n) joins and no chain is gathered anywhere.
    """
    keys = [F.col(chain).alias("chain"), F.col(cursor).alias("cursor")]
    given = pages.select(*keys, F.col(before).alias("before"), F.coalesce(matches, F.lit(False)).alias("hit"))
    given = given.groupBy("chain", "cursor").agg(F.max("hit").alias("hit"), F.min("before").alias("before"))
    there = given.select(F.col("chain").alias("c"), F.col("cursor").alias("there"))
    joined = given.join(there, given["chain"].eqNullSafe(there["c"]) & (given["before"] == there["there"]), "left")
    status = F.when(F.col("hit"), "found").when(F.col("before").isNull(), "exhausted").when(F.col("there").isNull(), "missing")
    at = F.when(status.isNull(), F.col("before")).when(status == "missing", F.col("before")).otherwise(F.col("cursor"))
    spark, path = pages.sparkSession, shared.place(pages.sparkSession, "chains")
    nodes = shared.placed(joined.select("chain", "cursor", at.alias("at"), status.alias("status"), F.lit(1).cast("long").alias("n_read")), path)
    # a step of pages that go on: from where they lead to, further
    rounds = 1 + math.ceil(math.log2(max(2, nodes.count())))
    for _ in range(rounds):
        if nodes.where("status is null").isEmpty():
            break
        on = nodes.select(F.col("chain").alias("c"), F.col("cursor").alias("via"), F.col("at").alias("to"), F.col("status").alias("then"), F.col("n_read").alias("more"))
        open_ = nodes.where("status is null")
        moved = open_.join(on, open_["chain"].eqNullSafe(on["c"]) & (open_["at"] == on["via"]))
        moved = moved.select("chain", "cursor", F.col("to").alias("at"), F.col("then").alias("status"), (F.col("n_read") + F.col("more")).alias("n_read"))
        old, path = path, shared.place(spark, "chains")
        nodes = shared.placed(nodes.where("status is not null").unionByName(moved), path)
        shared.remove(spark, old)
    first = starts.select(*keys).distinct()
    first = first.select(F.col("chain").alias("c"), F.col("cursor").alias("start"))
    found = first.join(nodes, first["c"].eqNullSafe(nodes["chain"]) & (first["start"] == nodes["cursor"]), "left")
    ended = F.coalesce("status", F.when(F.col("cursor").isNull(), "missing").otherwise("endless"))
    ended = F.when(F.col("n_read") > most, "limit").otherwise(ended)
    stopped = F.when(F.col("cursor").isNull(), F.col("start")).when(~ended.isin("endless", "limit"), F.col("at"))
    return found.select(F.col("c").alias(chain), ended.alias("status"), stopped.alias(cursor), F.when(ended != "endless", F.coalesce("n_read", F.lit(0))).alias("n_read"))

"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_words, own_names, table

Pattern = tuple[str | None, ...]
#: Patterns whose plan (some 100 bytes each) is broadcast; more meet the rows in a shuffled join.
MOST = 1 << 18


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words wanted of each source.

    Sources in code-point order, null last, take `weights` in turn and share `share` times all
    sizes; a target stops at `most` times its source's size and the excess is shared again by
    weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    rest, open_ = share * sum(sizes.values()), list(order)
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not above:
            return out | {s: weight[s] * unit for s in open_}
        out |= {s: most * sizes[s] for s in above}
        rest -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


class Routes:
    """Flow from patterns to their sources, held in flat arrays: some 30 bytes for each source of each pattern.

    The residual graph is that of the sources alone: words move from source s to t within
    patterns that lie in both and send words to s.  The steps of a path that meets no source
    twice take from different arcs, so a path's room is the least of its steps'.
    """

    def __init__(self, starts: np.ndarray, members: np.ndarray, room: np.ndarray):
        self.members, self.room = members, room.copy()
        self.starts, self.of = starts, np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.argsort(members, kind="stable")
        ends = np.searchsorted(members[order], np.arange(len(room) + 1))
        self.arcs = [order[a:b] for a, b in zip(ends[:-1], ends[1:])]
        self.flow = np.zeros(len(members), np.int64)
        self.supply = np.zeros(len(starts) - 1, np.int64)

    def _shared(self, s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of s and t in the patterns that hold both."""
        _, x, y = np.intersect1d(self.of[self.arcs[s]], self.of[self.arcs[t]], assume_unique=True, return_indices=True)
        return self.arcs[s][x], self.arcs[t][y]

    @staticmethod
    def _first(held: np.ndarray, wanted: int) -> np.ndarray:
        """`wanted` words in all, taken from the first places that hold some."""
        before = np.cumsum(held) - held
        return np.clip(wanted - before, 0, held)

    def _below(self, s: int) -> np.ndarray:
        """Sources that words of s can move to."""
        patterns = self.of[self.arcs[s][self.flow[self.arcs[s]] > 0]]
        sizes = self.starts[patterns + 1] - self.starts[patterns]
        at = np.repeat(self.starts[patterns] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.unique(self.members[at])

    def _path(self) -> list[int] | None:
        """A shortest way from a source that can be given words to one with room."""
        came: dict[int, int] = {}
        level = np.unique(self.members[self.supply[self.of] > 0]).tolist()
        came |= dict.fromkeys(level, -1)
        while level:
            for s in level:
                if self.room[s] > 0:
                    path = [s]
                    while came[path[-1]] >= 0:
                        path.append(came[path[-1]])
                    return path[::-1]
            further = []
            for s in level:
                for t in self._below(s).tolist():
                    if t not in came:
                        came[t] = s
                        further.append(t)
            level = further
        return None

    def open(self, supply: np.ndarray) -> None:
        """Let patterns send so many words more, as many as there is a way for."""
        self.supply += supply
        while (path := self._path()) is not None:
            pairs = [self._shared(s, t) for s, t in zip(path[:-1], path[1:])]
            mine = self.arcs[path[0]]
            least = min(int(self.supply[self.of[mine]].sum()), int(self.room[path[-1]]), *(int(self.flow[x].sum()) for x, _ in pairs))
            given = self._first(self.supply[self.of[mine]], least)
            self.supply[self.of[mine]] -= given
            for x, y in pairs:
                moved = self._first(self.flow[x], least)
                self.flow[x] -= moved
                self.flow[y] += moved
            self.flow[mine] += given
            self.room[path[-1]] -= least


def routed(starts: np.ndarray, members: np.ndarray, sizes: np.ndarray, quota: np.ndarray, copies: int) -> np.ndarray:
    """Words to take of each pattern: the cheapest flow from patterns to source quotas.

    The k-th copy of a pattern's words costs k - 1 a word, a convex cost, so all first copies
    anywhere are used before second ones.  As the cost depends on the copy alone, opening the
    copies one after another and filling the residual graph gives the minimum-cost flow.
    Pattern i has the sources members[starts[i] : starts[i + 1]].
    """
    ways = Routes(starts, members, quota)
    for _ in range(copies):
        ways.open(np.where(np.diff(starts) > 0, sizes, 0))
    sums = np.zeros(len(sizes), np.int64)
    np.add.at(sums, ways.of, ways.flow)
    return sums


def route(patterns: dict[Pattern, int], quota: dict[str | None, float], copies: int = 2) -> dict[Pattern, int]:
    """`routed` by names."""
    names = {s: i for i, s in enumerate(quota)}
    starts = np.concatenate([[0], np.cumsum([len(k) for k in patterns])]).astype(np.int64)
    members = np.array([names[s] for k in patterns for s in k], np.int64)
    found = routed(starts, members, np.array(list(patterns.values()), np.int64), np.array([round(q) for q in quota.values()], np.int64), copies)
    return dict(zip(patterns, found.tolist(), strict=True))


def mix(docs: DataFrame, id_col: str, size: Column, sources: Column, key: Column | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, copies: int = 2, seed: int = 7, bin_rows: int = 1000) -> DataFrame:
    """(id, size, pattern, source_size, target, taken, copies) of every row of `docs`.

    `sources` is the array of sources that a row belongs to (duplicates and order are
    immaterial; an empty or null array belongs to none and is not taken).  Rows are summed by
    membership pattern; only these sums reach the driver, as arrays of some 30 bytes for each
    source of each pattern, and the flow routes words to the targets, exactly for any number of patterns.  Then every document
    of a pattern gets the whole copies that fit, and documents in a seeded hash order one copy
    more: bins of about `bin_rows` documents are summed and accumulated, whole bins are taken,
    and only in the bin where the sum is reached documents are fitted one by one.  So no step
    orders or gathers a whole source, and reruns agree.

    Documents are taken whole.  `source_size` and `target` are summed over the row's sources.
    Sizes that are null count as 0, and rows of size 0 are never taken.  Rows that repeat an id
    are separate rows in one place of the order, unless `key`, a hash of what tells rows apart (the id by
    default), differs: so null ids need not share one place.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))).alias("belongs"), (F.col(f"`{id_col}`") if key is None else key).alias("key"),
    )
    # 31 bits of the order, for even bins, then the whole hash
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "key")).withColumn("place", F.shiftrightunsigned("h", 33))
    rows = table(rows.drop("key"), "mix")
    rows = rows.withColumnRenamed("belongs", "pattern")
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toArrow().combine_chunks()
    patterns, sums, n = found["pattern"].combine_chunks(), found["size"].to_numpy(), found["n"].to_numpy()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(patterns).to_numpy())]).astype(np.int64)
    coded = pc.list_flatten(patterns).dictionary_encode(null_encoding="encode")
    names, member = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(sums)), np.diff(starts))
    held = np.zeros(len(names), np.int64)
    np.add.at(held, member, sums[of])
    quota = targets(dict(zip(names, held.tolist(), strict=True)), weights, share, copies)
    wanted = np.array([quota[s] for s in names], np.float64)
    flow = routed(starts, member, sums, np.array([round(x) for x in wanted.tolist()], np.int64), copies)
    base = np.minimum(copies, flow // np.maximum(sums, 1))
    own_size, own_target = np.zeros(len(sums), np.int64), np.zeros(len(sums))
    np.add.at(own_size, of, held[member])
    np.add.at(own_target, of, wanted[member])
    plan = pa.table({"pattern": patterns, "source_size": own_size, "target": own_target, "base": base.astype(np.int64), "need": flow - base * sums, "bins": np.maximum(1, -(-n // bin_rows))})
    planned = spark.createDataFrame(plan)
    planned = F.broadcast(planned) if len(sums) <= MOST else table(planned, "plan")
    joined = rows.join(planned, "pattern").withColumn("bin", F.floor(F.col("place") * F.col("bins") / F.lit(float(1 << 31))))
    bins = joined.groupBy("pattern", "bin").agg(F.sum("size").alias("held"), F.first("need").alias("need"))
    before = F.sum("held").over(Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn("left", F.col("need") - F.coalesce(before, F.lit(0))).select("pattern", "bin", "held", "left")
    placed = joined.join(bins, ["pattern", "bin"]).drop("need", "bins", "place")
    whole = placed.where("left <= 0 or held <= left").withColumn("more", F.when(F.col("left") > 0, 1).otherwise(0).cast("long"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        """In hash order, whatever still fits."""
        rows = rows.sort_values(["h", "size"], kind="stable")
        left, more = int(rows["left"].iloc[0]), []
        for n in rows["size"]:
            more.append(int(n <= left))
            left -= n * more[-1]
        return rows.assign(more=more)

    edge = placed.where("left > 0 and held > left")
    edge = edge.groupBy("pattern", "bin").applyInPandas(fit, whole.select(edge.columns + ["more"]).schema)
    done = whole.select(edge.columns).union(edge).withColumn("copies", F.when(F.col("size") > 0, F.col("base") + F.col("more")).otherwise(0))
    return done.select("id", "size", "pattern", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, **how) -> DataFrame:
    """`mix` for documents of one source each, sized by their words."""
    given = own_names(docs, id=id_col, text=text_col, source=source_col)
    return mix(given, "id", count_words(F.col("text")), F.array(F.col("source").cast("string")), key=F.xxhash64("id", "text"), **how)

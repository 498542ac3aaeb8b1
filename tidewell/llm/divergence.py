"""Source divergence audit: every two sources of a language compared over its whole vocabulary, in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, joinable, map_arrow, own_names, table
from ..shipping import ship

#: Bytes between terms: ASCII but letters.
_MARKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Probabilities are whole billionths.
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Audit:
    """Terms are kept from `least` documents of their language on; the `top` terms of a group are listed.

    A block has about `groups` sources, a vocabulary chunk about `terms` terms, and a tile task
    passes over `slab` chunks: its memory is bounded by these three, whatever the table holds.
    """

    least: int = 3
    top: int = 200
    groups: int = 32
    terms: int = 2048
    slab: int = 4


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that hold it.

    Each batch of texts is counted in its worker, so that what is shuffled are sums of terms, never words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=_MARKS)
            words = pa.table({"row": pc.list_parent_indices(cut), "term": pc.list_flatten(cut)})
            words = words.filter(pc.not_equal(words["term"], ""))
            each = words.group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
            of = pc.take(pa.table({"lang": batch.column("lang"), "source": batch.column("source")}), each["row"])
            rows = pa.table({"lang": of["lang"], "source": of["source"], "term": each["term"], "n": each["count_all"]})
            sums = rows.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
            yield from pa.table({"lang": sums["lang"], "source": sums["source"], "term": sums["term"], "n": sums["n_sum"], "docs": sums["n_count"]}).to_batches(1 << 16)

    counted = map_arrow(docs, run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """Smoothed probability in billionths, exactly: 1 + floor(SCALE * (count + 1) / total)."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole, total.cast("decimal(19,0)"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """`share` of an array, by long division in steps of a thousand: exact while total is below 9e15, and count + 1 is at most total."""
    left, out, total = counts.astype(np.int64) + 1, np.zeros(len(counts), np.int64), max(total, 1)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def compare(given: pa.Table) -> pa.Table:
    """The pair submatrix of one tile over the chunks it holds: (lang, source, item, value) for each ordered pair of different groups.

    Rows are packed count vectors: a group of the tile's two blocks, a chunk, and places and counts of the terms that occur.
    """
    low, high = given["low"][0].as_py(), given["high"][0].as_py()
    sources: dict[str, int] = {}
    for s in sorted(set(given["source"].to_pylist())):
        sources[s] = len(sources)
    block = np.zeros(len(sources), np.int64)
    rows = list(zip(given["chunk"].to_pylist(), (sources[s] for s in given["source"].to_pylist()), given["block"].to_pylist(), given["total"].to_pylist(), given["width"].to_pylist(), given["places"], given["counts"], strict=True))
    values = np.zeros((len(sources), len(sources)), np.int64)
    by_chunk: dict[int, list] = {}
    for row in rows:
        by_chunk.setdefault(row[0], []).append(row)
        block[row[1]] = row[2]
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    for members in by_chunk.values():
        p = np.ones((len(sources), members[0][4]), np.int64)
        for _, k, _, total, _, places, counts in members:
            p[k] = shares(np.zeros(1, np.int64), total)[0]
            if places.is_valid and len(places):
                p[k, places.values.to_numpy()] = shares(counts.values.to_numpy(), total)
        other = p[right]
        for i in left.tolist():
            square = (p[i] - other) ** 2
            values[i, right] += (square // other).sum(axis=1)
            if low != high:
                values[right, i] += (square // p[i]).sum(axis=1)
    names = list(sources)
    a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    if low != high:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    a, b = a[a != b], b[a != b]
    return pa.table({"lang": pa.array([given["lang"][0].as_py()] * len(a), pa.string()), "source": pa.array([names[i] for i in a.tolist()], pa.string()), "item": pa.array([names[i] for i in b.tolist()], pa.string()), "value": values[a, b]})


def pair_values(kept: DataFrame, groups: DataFrame, chunks: DataFrame, given: Audit) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of different groups of a language, summed over all its kept terms.

    Sources are dealt to blocks and terms to chunks by hash.  Each packed vector goes to every
    tile, a pair of blocks over a slab of chunks, that its block takes part in; tiles give their
    part of the sums.
    """
    packed = kept.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("v"))
    packed = packed.select("lang", "source", "chunk", F.transform("v", lambda x: x["place"]).alias("places"), F.transform("v", lambda x: x["n"]).alias("counts"))
    blocks = table(groups.groupBy("lang").agg(F.ceil(F.count("*") / given.groups).cast("int").alias("blocks")), "blocks")
    blocked = groups.join(joinable(blocks), "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    # every group has a vector in every chunk, also where none of its terms occurs
    frame = blocked.join(joinable(chunks), "lang", "left").withColumns({"chunk": F.coalesce("chunk", F.lit(0)), "width": F.coalesce("width", F.lit(0))})
    vectors = frame.join(packed, ["lang", "source", "chunk"], "left")
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("low"), F.greatest(x, "block").alias("high"))))
    spread = vectors.select("lang", "source", "chunk", "width", "block", (F.col("n_kept") + F.col("v_kept")).alias("total"), "places", "counts", tiles.alias("tile"), F.floor(F.col("chunk") / given.slab).alias("slab"))
    spread = spread.select("*", "tile.low", "tile.high").drop("tile")
    ship(kept.sparkSession)
    parts = spread.groupBy("lang", "low", "high", "slab").applyInArrow(compare, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str, lang_col: str, source_col: str, given: Audit | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and which terms set it apart.

    Terms are runs of letters and non-ASCII characters, A to Z lower-cased; a language keeps
    those of at least `least` of its documents (V terms).  In a group (language and source) of N
    kept occurrences, p of a term is 1 + floor(10^9 (count + 1) / (N + V)); q likewise for what
    it is compared with, and f = floor((p - q)^2 / q), all in whole numbers.  Part `pair`: item
    is each other source of the language, value the sum of f over all kept terms.  Part `term`:
    item is a kept term of the group with p above the language's q, value its f, the first
    `top`.  Ranks go by falling value, then by the item's bytes.

    Null texts, languages and sources are ''.  Every group that occurs is compared, also one
    without kept terms; a language without kept terms gives 0 for each pair.  Repeated rows are
    documents of their own.  Other columns are ignored; an empty table gives no rows.  Texts of
    any length are counted whole.
    """
    given = given or Audit()
    rows = own_names(docs, text=text_col, lang=lang_col, source=source_col)
    rows = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns))
    counts = table(count_terms(rows), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= given.least).drop("docs")
    terms = table(terms, "terms")
    sizes = table(terms.groupBy("lang").agg(F.count("*").alias("v_kept"), F.sum("total").alias("n_lang")), "sizes")
    cut = terms.join(joinable(sizes), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("v_kept") / given.terms)).cast("int"))
    vocabulary = table(cut.select("lang", "term", "total", "chunk", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("place")), "vocabulary")
    chunks = table(vocabulary.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width")), "chunks")
    kept = table(counts.select("lang", "source", "term", "n").join(vocabulary, ["lang", "term"]), "kept")
    drop_table(counts, terms)
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_kept"))
    none = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(joinable(sizes), "lang", "left")
    groups = table(groups.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("n_kept", "v_kept", "n_lang"))), "groups")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, groups, chunks, given).withColumn("rank", F.row_number().over(ranked))
    p, q = share(F.col("n"), F.col("n_kept") + F.col("v_kept")), share(F.col("total"), F.col("n_lang") + F.col("v_kept"))
    apart = kept.join(joinable(groups), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    apart = apart.select("lang", "source", "item", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    # a hot group is ranked in sixteen parts first
    salted = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(16))).orderBy(F.desc("value"), "item")
    first = apart.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= given.top).drop("rank")
    top = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= given.top)
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(top, "term"))

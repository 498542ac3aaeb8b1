"""Near-duplicate documents by HyperMinHash registers, banded, then verified on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import beside, drop_table, joinable, map_arrow, only, own_names, table
from .graph import linked
from .hashing import BLANKS, chain, couple_keys, mix, pieces, strings, words

#: Constant of the expected share of equal registers of unrelated sets (HyperMinHash paper, section on collisions).
COLLISION = 0.169919487159739


@dataclass(frozen=True)
class HyperMinHash:
    """Parameters: shingle width, similarity as a percentage, 2**buckets registers of `mantissa` bits, `rows` registers a band, shingles up to which a set's links are found exactly."""

    width: int = 3
    percent: int = 85
    buckets: int = 7
    mantissa: int = 10
    rows: int = 5
    short: int = 30


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than `width` are one shingle; no words give none."""
    w = words(data, offsets, BLANKS)
    whole = chain([w.hashes[i : len(w.hashes) - width + 1 + i] for i in range(width)]) if len(w.hashes) >= width else np.zeros(0, np.uint64)
    for lo, hi in zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True):
        if hi - lo >= width:
            yield np.unique(whole[lo : hi - width + 1])
        else:
            yield chain([w.hashes[i : i + 1] for i in range(lo, hi)]) if hi > lo else np.zeros(0, np.uint64)


def registers(shingles: np.ndarray, p: HyperMinHash) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that hold something, and their compressed minima: leading zeros, then the bits after the first one."""
    bucket = shingles >> np.uint64(64 - p.buckets)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    rest = (shingles[first] << np.uint64(p.buckets)) | np.uint64(1 << (p.buckets - 1))  # never zero
    bits = np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]  # exact: 53 bits at most
    zeros = (53 - np.maximum(bits, 1)).astype(np.uint64)
    tail = ((rest << zeros) << np.uint64(1)) >> np.uint64(64 - p.mantissa)
    return bucket[first].astype(np.int64), ((zeros << np.uint64(p.mantissa)) | tail) + np.uint64(1)


def band_keys(at: np.ndarray, values: np.ndarray, p: HyperMinHash) -> np.ndarray:
    """One key for each band of `rows` neighbouring buckets that holds something.

    A band takes `rows` filled registers from its first one on, around the end if need be,
    so that sets of few shingles, which leave most buckets empty, get full bands as well.
    """
    if not len(at):
        return np.zeros(0, np.uint64)
    marked = mix((at.astype(np.uint64) << np.uint64(32)) | values)
    band = at // p.rows
    first = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
    members = [marked[(first + i) % len(marked)] for i in range(p.rows)]
    return chain([mix(band[first].astype(np.uint64)), *members])


def set_keys(sets: list[np.ndarray], bands: list[np.ndarray], p: HyperMinHash) -> list[np.ndarray]:
    """The candidate keys of each set: those of its bands if it has more than `short` members, and couples if it may be linked to one that has not.

    Sets of few members fill few registers, and bands of these miss links; two sets of which one
    has up to `short` members meet by `couple_keys`, which miss none.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    few = np.flatnonzero((n > 0) & (p.percent * n <= 100 * p.short))
    row, key = couple_keys(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(n)]), few, p.percent)
    order = np.argsort(row, kind="stable")
    couples = np.split(key[order], np.cumsum(np.bincount(row, minlength=len(sets)))[:-1]) if len(sets) else []
    return [np.concatenate([b, c]) if size > p.short else c for size, b, c in zip(n.tolist(), bands, couples, strict=True)]


def sketches(docs: DataFrame, p: HyperMinHash) -> DataFrame:
    """(id, n, digest, registers, keys) of each row; texts are read whole and go no further."""
    size = 1 << p.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in pieces(offsets):
                n, digest, regs, bands, sets = [], [], [], [], []
                for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], p.width):
                    at, values = registers(s, p)
                    full = np.zeros(size, np.uint16)
                    full[at] = values
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    regs.append(full.tobytes())
                    bands.append(band_keys(at, values, p))
                    sets.append(s)
                keys = [k.view(np.int64) for k in set_keys(sets, bands, p)]
                sizes = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary()), listed], ["id", "n", "digest", "registers", "keys"])

    return map_arrow(docs, run, "id long, n long, digest binary, registers binary, keys array<long>")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, p: HyperMinHash) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of paired register rows, and the registers each rests on."""
    either = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    ratio = np.maximum(n_a, n_b) / np.maximum(np.minimum(n_a, n_b), 1)
    chance = COLLISION * 2.0 ** (p.buckets - p.mantissa) * 4 * ratio / (1 + ratio) ** 2
    chance = np.minimum(chance, np.maximum(either - 1, 0))
    return np.clip((same - chance) / np.maximum(either - chance, 1), 0, 1), either


def _by_number(given: DataFrame, p: HyperMinHash) -> DataFrame:
    """Components of rows (id, text) with ids of any ordered type, by way of numbers in the same order."""
    order = given.select("id").where("id is not null").distinct().orderBy("id")
    numbers = joinable(table(order.select(F.col("id").alias("name"), F.monotonically_increasing_id().alias("number")), "numbers"))
    numbered = given.join(numbers, F.col("id") == F.col("name"), "left").select(F.col("number").alias("id"), "text")
    found = components_by_hyperminhash(numbered, "id", "text", p)
    named = lambda c, to: numbers.select(F.col("number").alias(c), F.col("name").alias(to))
    found = found.join(named("id", "own"), "id", "left").join(named("component_id", "least"), "component_id", "left")
    return found.select(F.col("own").alias("id"), "n_shingles", F.col("least").alias("component_id"), "kept")


def components_by_hyperminhash(docs: DataFrame, id_col: str, text_col: str, p: HyperMinHash = HyperMinHash()) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of `docs`.

    Items are linked if their sets of word shingles have 100 * intersection >= percent * union;
    a component is named by its smallest id.  Equal sets are put together first by a digest,
    so copies cost one sketch each and never a pair.  Candidates come from bands of compressed
    registers, and for sets of up to `short` shingles from pairs of a prefix, which miss none; the corrected estimate weeds out pairs far (four standard errors) below the
    threshold; the rest are verified on their full sets.

    Null and blank texts have an empty set and stay alone (component = own id).  A row with
    a null id links to nothing and is kept; its component is that of equal texts with an id, else null.  Rows that repeat an id share its component if their
    texts do; extra columns are ignored.  An empty table gives no rows.  Ids other than whole
    numbers are numbered in their order first.
    """
    given = own_names(docs, id=id_col, text=text_col)
    kind = given.schema["id"].dataType
    if not isinstance(kind, IntegralType):
        return _by_number(given, p)
    given = given.withColumn("id", F.col("id").cast("long"))
    sketched = table(sketches(given, p), "sketches")
    groups = sketched.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"))
    groups = table(groups, "groups")
    reps = table(sketched.join(groups.select("digest", F.col("rep").alias("id")), ["digest", "id"]).dropDuplicates(["id", "digest"]), "reps")
    bands = reps.select("id", "n", F.explode("keys").alias("key"))
    floor, size = p.percent / 100, 1 << p.buckets

    ready: dict[str, DataFrame] = {}

    def gather(ids: DataFrame) -> None:
        """Sketches and texts of the documents that have candidates."""
        ids = table(ids.select("id"), "candidates")
        ready["sketches"] = table(only(reps.drop("keys", "digest"), ids), "sketches")
        ready["texts"] = table(only(given, ids), "texts")
        drop_table(ids, reps)

    def weed(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(-1, size) for c in ("registers_a", "registers_b"))
                got, base = estimate(a, b, t.column("n_a").to_numpy(), t.column("n_b").to_numpy(), p)
                keep = got >= floor - 4 * np.sqrt(floor * (1 - floor) / np.maximum(base, 1))
                yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(got)], ["a", "b", "score"]).filter(pa.array(keep))

        paired = beside(pairs, ready["sketches"], "n", "registers").where(f"100 * least(n_a, n_b) >= {p.percent} * greatest(n_a, n_b)")
        return map_arrow(paired.select("a", "b", "n_a", "n_b", "registers_a", "registers_b"), run, "a long, b long, score double")

    def verify(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                keep = np.zeros(t.num_rows, bool)
                (da, oa), (db, ob) = strings(t.column("text_a")), strings(t.column("text_b"))
                for lo, hi in pieces(oa + ob):
                    sides = [shingle_sets(d[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], p.width) for d, o in ((da, oa), (db, ob))]
                    for i, (x, y) in enumerate(zip(*sides, strict=True), lo):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        keep[i] = 100 * both >= p.percent * (len(x) + len(y) - both)
                yield t.select(["a", "b"]).filter(pa.array(keep))

        return map_arrow(beside(pairs, ready["texts"], "text").select("a", "b", "text_a", "text_b"), run, "a long, b long")

    def sets(ids: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                data, offsets = strings(t.column("text"))
                for lo, hi in pieces(offsets):
                    own = [s.view(np.int64) for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], p.width)]
                    yield pa.RecordBatch.from_arrays([t.column("id").slice(lo, hi - lo), pa.array(own, pa.list_(pa.int64()))], ["id", "members"])

        return map_arrow(ready["texts"].join(ids, "id", "left_semi"), run, "id long, members array<long>")

    found = linked(bands, weed, verify, sets, p.percent, gather=gather)
    drop_table(*ready.values())
    named = groups.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return sketched.select("id", "n", "digest").join(named, "digest", "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))

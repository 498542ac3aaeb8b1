"""Fuzzy line deduplication in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, drop_table, joinable, let, table
from .graph import PARITIES, linked

#: Blanks that are stripped from both ends of a line.
_ENDS = " \t\n\x0b\x0c\r"
#: Bytes of a code point in the encoding that shingles are cut from.
_WIDE = 4


@dataclass(frozen=True)
class LineMinHash:
    """Parameters: shingle width in characters, similarity in percent, bands (ranges of hashes), minima of a band (row count), shingles up to which a line's links are found exactly."""

    width: int = 8
    percent: int = 80
    bands: int = 16
    rows: int = 4
    short: int = 24


def shingles(line: Column, p: LineMinHash) -> Column:
    """Hashes of a line's shingles in their order, repeated ones too; a line shorter than one shingle is its only one.

    In UTF-32 every shingle is a slice at a fixed place, so none is searched for.
    """
    last = lambda b: F.greatest(F.octet_length(b) - F.lit(_WIDE * p.width - 1), F.lit(1))
    cut = lambda b: F.transform(F.sequence(F.lit(1), last(b), F.lit(_WIDE)), lambda i: F.xxhash64(F.substr(b, i, F.lit(_WIDE * p.width))))
    return let(F.encode(line, "UTF-32"), cut)


def hashes(line: Column, p: LineMinHash) -> Column:
    """Sorted hashes of a line's distinct shingles."""
    return F.sort_array(F.array_distinct(shingles(line, p)))


def with_band_keys(rows: DataFrame, p: LineMinHash) -> DataFrame:
    """`rows` (id, line) as (id, n, keys): the number of distinct shingles and the candidate keys of each line.

    The signature is one-permutation MinHash: the hashes fall into `bands` ranges of equal
    width, and the `rows` smallest from the start of a range on (around the end if need be) are
    its minima; a range that holds nothing has no key.  Two sets share the key of a range if
    the `rows` smallest of their union there lie in both.

    Short lines leave most ranges thin and would miss links: two lines of which one has up to
    `short` shingles meet by `_couples`, which misses none, others by bands.  The other line of
    such a pair may be longer, so lengths between have both kinds of keys.
    """
    placed = _placed(rows.select("id", hashes(F.col("line"), p).alias("h")), p.bands)

    def key(b: int) -> Column:
        members = [F.get("h", (F.col(f"at{b}") + j) % F.size("h")) for j in range(p.rows)]
        return F.when(F.col(f"at{b}") < F.col(f"at{b + 1}"), F.xxhash64(F.lit(b), *members))

    n = F.size("h")
    # array_compact also keeps the optimizer from writing the array, and so the hashes, into each branch below
    bands = placed.select("id", "h", F.array_compact(F.array(*map(key, range(p.bands)))).alias("bands"))
    keys = F.when(n <= p.short, _couples(F.col("h"), p)).when(p.percent * n <= 100 * p.short, F.concat(_couples(F.col("h"), p), "bands")).otherwise(F.col("bands"))
    return bands.select("id", n.cast("long").alias("n"), keys.alias("keys"))


def _placed(rows: DataFrame, bands: int) -> DataFrame:
    """`rows` (id, h: sorted hashes) with at0, at1 ...: how many hashes lie before each of `bands` ranges, and all of them last.

    The bounds are sorted in among the hashes, and a bound's place there tells the number before
    it; so no lambda runs over the hashes.
    """
    bounds = [-(1 << 63) + b * ((1 << 64) // bands) for b in range(bands)]
    sorted_in = rows.select("id", "h", F.sort_array(F.concat("h", F.array(*map(F.lit, bounds)))).alias("s"))
    at = [(F.array_position("s", bound) - (b + 1)).cast("int").alias(f"at{b}") for b, bound in enumerate(bounds)]
    return sorted_in.select("id", "h", *at, F.size("h").alias(f"at{bands}"))


def _couples(hashes: Column, p: LineMinHash) -> Column:
    """Keys that any two linked lines share, whatever their size: the pairs of hashes of a prefix.

    Linked sets share at least `percent` % of either one, s of its n members, and so the first
    two of those lie among the first n - s + 2 of both.  A set of one member links only to its equals.
    """
    prefix = F.slice(hashes, 1, F.size(hashes) - F.ceil(p.percent * F.size(hashes) / 100).cast("int") + 2)
    pairs = let(prefix, lambda hs: F.flatten(F.transform(hs, lambda x, i: F.transform(F.slice(hs, i + 2, F.size(hs)), lambda y: F.xxhash64(F.lit("couple"), x, y)))))
    return F.when(F.size(hashes) == 1, hashes).otherwise(pairs)


def with_parities(sets: DataFrame) -> DataFrame:
    """(id, bits) of sets (id, members: different longs, one row an id): a bit is set if an odd number of members fall into its class.

    Members are taken apart and summed by generated code; a lambda for each long of parities would pass over all members again.
    """
    h = F.col("h")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    apart = sets.select("id", F.explode_outer("members").alias("h")).select("id", F.shiftright(h, 6).bitwiseAND(PARITIES - 1).alias("k"), bit.alias("bit"))
    return apart.groupBy("id").agg(F.array(*(F.bit_xor(F.when(F.col("k") == k, F.col("bit")).otherwise(0)) for k in range(PARITIES))).alias("bits"))


def _named(line: str = "line") -> list[Column]:
    """A line's name: 128 bits of hash."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _lines(text: str) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_ENDS)))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(id, h1, h2, line, c) of the distinct texts in `lines` (`line`), a written table: id numbers them, c counts their occurrences."""
    return table(lines.groupBy("line").agg(F.count("*").alias("c")).select(F.monotonically_increasing_id().alias("id"), *_named(), "line", "c"), "lines")


def line_components(lines: DataFrame, p: LineMinHash = LineMinHash()) -> DataFrame:
    """(id, component) of the lines (id long, line; a written table of different lines) that are linked to others.

    Lines are linked if the Jaccard similarity of their character-shingle sets is `percent` %
    or more, verified on the full sets for every candidate of the bands; a component is closed
    under links and is named by its least id.
    """
    # the outer form: a plain explode would have its array computed once more, to filter empty ones
    bands = with_band_keys(lines, p).select("id", "n", F.explode_outer("keys").alias("key")).where("key is not null")
    texts: list[DataFrame] = []

    def gather(ids: DataFrame) -> None:
        ids = table(ids, "candidates")
        texts.append(table(lines.select("id", "line").join(joinable(ids), "id"), "texts"))
        drop_table(ids)

    def verify(pairs: DataFrame) -> DataFrame:
        joined = beside(pairs, texts[0], "line", "n").where(f"100 * least(n_a, n_b) >= {p.percent} * greatest(n_a, n_b)")
        both = F.size(F.array_intersect(shingles(F.col("line_a"), p), shingles(F.col("line_b"), p)))  # counts none twice
        return joined.where((100 + p.percent) * both >= p.percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")

    def own(ids: DataFrame) -> DataFrame:
        return texts[0].join(ids, "id", "left_semi").select("id", F.array_distinct(shingles(F.col("line"), p)).alias("members"))

    def parities(ids: DataFrame) -> DataFrame:
        return with_parities(own(ids))

    found = linked(bands, lambda pairs: pairs.withColumnRenamed("hits", "score"), verify, own, p.percent, small=16, gather=gather, few=0, parities=parities)
    drop_table(*texts)
    return found


def dedup_lines(docs: DataFrame, id_col: str, text_col: str, p: LineMinHash = LineMinHash(), carry: Sequence[str] = (), broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(id, text, n_lines, n_kept, removed, and `carried`, a struct of the columns `carry` if given) of every row: `text` without lines met before.

    Lines are split at newlines and stripped of blanks at both ends for comparison; blank lines
    are not compared and stay.  Of each component of equal and similar lines (Jaccard of
    character shingles at least `percent` %), the line of the smallest (id, position) stays.
    `n_lines` counts lines with a word, `removed` holds the 0-based positions taken out.

    A null text stays null with no lines; a null id comes first in the order.  Rows that
    repeat both id and text share their lines' place and keep the same ones; rows that repeat
    an id with other texts are apart.  Columns not carried are ignored.  An empty table gives no rows.
    Equal lines meet by their text, occurrences meet their line by 128 bits of hash.
    """
    kept_on = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None)
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), kept_on.alias("carried"))
    lines = distinct_lines(given.select(F.explode_outer(_lines("text")).alias("line")).where("line <> ''"))
    found = line_components(lines.select("id", "line"), p)
    # a line that is met once and linked to no other stays: only the rest has to find its occurrences
    marked = lines.select("id", "h1", "h2", "c").join(found, "id", "left").where("c > 1 or component is not null").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    marked = table(marked, "marked")
    drop_table(lines, found)
    # doc and at (a hash of the text) name the row
    occurrences = given.select(F.col("id").alias("doc"), F.xxhash64("text").alias("at"), F.posexplode_outer(_lines("text")).alias("pos", "line")).where("line <> ''").select("doc", "at", "pos", *_named())
    places = table(occurrences.join(joinable(marked, 1 << 19), ["h1", "h2"]).select("doc", "at", "pos", "component"), "places")
    first = places.groupBy("component").agg(F.min(F.struct("doc", "pos", "at")).alias("first"))
    gone = places.join(first, "component").where(F.struct("doc", "pos", "at") != F.col("first")).groupBy("doc", "at").agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    gone = table(gone, "gone")
    drop_table(marked, places)
    size = gone.agg(F.sum(64 + 4 * F.size("removed"))).first()[0] or 0
    # texts stay where they are if the decisions are small, else they meet in a shuffled join
    gone = F.broadcast(gone) if size <= broadcast_bytes else gone.hint("shuffle_hash")
    mine = given.withColumn("at", F.xxhash64("text"))
    joined = mine.join(gone, mine["id"].eqNullSafe(gone["doc"]) & (mine["at"] == gone["at"]), "left").select("id", "text", "carried", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    n_lines = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(_ENDS)) != "")), F.lit(0))
    kept = let(F.split("text", "\n"), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("removed")), lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.size("removed") > 0, kept).otherwise(F.col("text"))
    counted = joined.select("id", text.alias("text"), F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), "removed", "carried")
    return counted.select("id", "text", "n_lines", (F.col("n_lines") - F.size("removed")).alias("n_kept"), "removed", *(["carried"] if carry else []))

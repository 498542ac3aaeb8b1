"""Links, components and candidate pairs as DataFrame plans.

No group is gathered in one task, save edge sets of a fixed size where the caller lets them, and every round ends
in a scratch table, so a lost executor costs one round at most.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MANY, drop_table, joinable, map_arrow, packed, sweep
from .common import table as _table


def table(df: DataFrame, tag: str, rows: int = MANY) -> DataFrame:
    """A scratch table of a step over at most `rows` rows."""
    return _table(packed(df, rows), tag)


#: Edge sets up to this many rows (a few MB) are settled in one task, larger ones by shuffles.
FEW = 200_000
#: Components of up to this many items (two numbers each) are broadcast to joins.
KNOWN = 1 << 19
#: Up to so many pairs are checked in one go: to sort out which may be spared costs more.
AT_ONCE = 1 << 17
#: Longs of parities of a set (a power of two), and pairs for each row that are compared by them rather than refined.  A quarter of as
#: many left most pairs of sets of some 500 members in doubt, as their difference fills the classes before it is too large for a link.
PARITIES = 16
CHEAP = 16


def components(edges: DataFrame, few: int | None = None, rows: int = MANY) -> DataFrame:
    """(id, component) of every id in `edges` (a, b longs): the smallest id reachable.

    Union-find by hooking and contraction: every node goes below its least lesser neighbour, which makes a
    forest; pointer doubling flattens it, and the edges between its trees are the next round's.  A chain of any
    length flattens in a logarithm of doublings, narrow joins that are broadcast while they are small; the minimum of
    a node's neighbours is a map-side combined aggregate, so hubs do no harm.  At most `few` edges
    (FEW by default) are settled by one task in Python (see `_settled`); with 0 all is
    done by joins.  `rows` bounds the tables' sizes for `table`.  Null ends and self-links are ignored; no edges give no rows.
    """
    few = FEW if few is None else few
    ends = lambda df: df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct()
    now, found = table(ends(edges), "edges", rows), None
    while n := now.count():
        settled = n <= few
        trees = table(_settled(now), "trees", rows) if settled else _flat(now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), rows)
        if settled and found is None:
            drop_table(now)
            return trees
        across = now.join(_named(trees, "u", "a"), "u", "left").join(_named(trees, "v", "b"), "v", "left").select(F.coalesce("a", "u").alias("a"), F.coalesce("b", "v").alias("b"))
        now, done = table(ends(across), "edges", rows), [now]
        if found is not None:  # what lies below a tree's root moves with it
            moved = found.join(_named(trees, "component", "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
            done += [found, trees]
            trees = table(moved.unionByName(trees), "components", rows)
        found = trees
        drop_table(*done)
    if found is None:
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    whole = table(found.unionByName(found.select(F.col("component").alias("id"), "component")).distinct(), "components", rows)
    drop_table(now, found)
    return whole


def _named(found: DataFrame, node: str, component: str) -> DataFrame:
    """A written table (id, component) as the side of a join, under other names."""
    return joinable(found, KNOWN).select(F.col("id").alias(node), F.col("component").alias(component))


def _flat(forest: DataFrame, rows: int) -> DataFrame:
    """The forest (id, component: a lesser node) with every node below its root; each pass goes up three times as far as the last."""
    now = table(forest, "forest", rows)
    while True:
        up = now.select("id", F.col("component").alias("p1")).join(_named(now, "p1", "p2"), "p1", "left").join(_named(now, "p2", "p3"), "p2", "left")
        after = table(up.select("id", F.coalesce("p3", "p2", "p1").alias("component"), F.col("p3").isNotNull().alias("deep")), "forest", rows)
        drop_table(now)
        flat, now = after.where("deep").isEmpty(), after.select("id", "component")
        if flat:
            return now


def _settled(edges: DataFrame) -> DataFrame:
    """(id, component) of at most FEW edges (u, v), by union-find with path halving in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if not ends:
            return
        ids, at = np.unique(np.concatenate(ends, 1), return_inverse=True)
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for u, v in zip(*at.reshape(2, -1).tolist(), strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[[find(x) for x in range(len(ids))]])], ["id", "component"])

    return map_arrow(edges.select("u", "v").coalesce(1), run, "id long, component long")


def linked(
    bands: DataFrame,
    weed: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    sets: Callable[[DataFrame], DataFrame],
    percent: int,
    small: int = 32,
    levels: int = 3,
    gather: Callable[[DataFrame], None] | None = None,
    few: int | None = None,
    parities: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(id, component) of all ids that some verified link touches; a component is named by its least id.

    `bands` has (id, n, key): an item, the size of its set and one band key per row; items
    under one key are candidates.  `weed` drops unpromising pairs
    (a, b, hits: keys shared) and adds `score`; `verify` keeps the true links; `sets` gives
    (id, members array<long>) of ids.  `gather`, if given, is first told which items (id, n) have
    candidates, to lay their contents ready; `few` is that of `components`; `parities`, if given, makes (id, bits: PARITIES longs)
    of ids, the numbers of a set's members in each of 64 * PARITIES classes modulo 2, by which the joins spare pairs that cannot be linked.  All pairs inside a key are never spelled out:

    1. Each item meets the least item of each of its keys, and its best-scored pair is verified;
       then the most linked item of each key that is still mixed.
    2. Keys whose items now share one component are done.  As soon as the pairs across components that
       are left under all keys are no more than AT_ONCE or the rows of `members` (CHEAP times those with parities), they are checked, and that is all.
    3. Other keys of up to `small` items: the pairs across components are checked, each item's
       most promising one before the rest.
    4. Items of larger ones are first tried with a few members of their group's main component.
       What is still mixed is refined (see `_refine`) to finer keys, on which this starts again.
       Every level adds what a key's items share to their consensus, so keys shrink; pairs
       across components of what is large even after `levels` levels are all checked.

    So every candidate pair ends inside one component or has been checked.  Ids and keys are
    not null; repeated rows of `bands` count once; no rows give no rows.
    """
    found, links, scrap, rows = None, [], [], 0
    for level in range(levels):
        sweep(bands.sparkSession)
        rep = bands.repartition("key")
        # both sides of the join read all columns, so that they share the exchange
        parts = [F.count("*").alias("c"), F.min("id").alias("p"), F.max("n").alias("top")]
        if found is None:
            pivots = rep.groupBy("key").agg(*parts).where("c > 1")
        else:  # keys inside one component need no more
            pivots = rep.groupBy("key").agg(*parts, F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        # most keys have one item: no need to sort them
        members = _table(rep.join(pivots.hint("shuffle_hash"), "key"), "members").select("key", "id", "n", "c", "p")
        drop_table(*scrap)
        rows = max(rows, members.count())
        hold, merge = functools.partial(table, rows=rows), functools.partial(_merged, few=few, rows=rows)
        most = max(AT_ONCE, CHEAP * rows if parities else rows)
        if gather and not level:
            gather(members.groupBy("id").agg(F.max("n").alias("n")))
        first, scrap = None, [members]
        rest = None if found is None else _mixed(members, found, hold)
        scrap += [] if rest is None else [rest]
        if rest is None or _crossing(rest) > most:
            tried = members.where("id <> p").groupBy(F.col("p").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("hits"))
            if found is not None:
                tried = _across(tried, found)
            first = hold(weed(tried).groupBy("b").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("a")), "first")
            links.append(hold(verify(first.select("a", "b")).select("a", "b"), "links"))
            found = merge(found, links[-1])
            rest = _mixed(members, found, hold)
            scrap += [first, rest]
        done = level == levels - 1 or _crossing(rest) <= most
        if not done:
            # a second try, with the most linked item of each key that is still mixed
            hubs = rest.join(_degrees(links), "id", "left").groupBy("key").agg(_most().alias("h"))
            again = rest.join(hubs, "key").where("id <> h").select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b"))
            again = _across(again.groupBy("a", "b").agg(F.count("*").alias("hits")).join(first, ["a", "b"], "left_anti"), found)
            again = hold(weed(again).groupBy("b").agg(F.max_by("a", F.struct("score", -F.col("a"))).alias("a")), "again")
            scrap.append(again)
            links.append(hold(verify(again.select("a", "b")).select("a", "b"), "links"))
            first = first.unionByName(again)
            if not links[-1].isEmpty():
                found = merge(found, links[-1])
                rest = _mixed(rest.drop("component", "main", "share"), found, hold)
                scrap.append(rest)
                done = _crossing(rest) <= most
        sweep(bands.sparkSession)
        large = rest.where(F.col("c") > small).select("key", "id")
        done = done or large.isEmpty()
        odd = None
        if parities:
            ids = hold(rest.select("id").distinct(), "ids")
            odd = hold(parities(joinable(ids, KNOWN)), "odd")
            scrap += [ids, odd]
        if not done:
            # a large key belongs to the group around the most linked item of its main component
            ends = _degrees(links)
            centre = found.join(ends, "id", "left").groupBy("component").agg(_most().alias("centre"))
            hubs = large.join(ends, "id", "left").groupBy("key").agg(_most().alias("id")).join(found, "id", "left").join(centre, "component", "left")
            groups = hold(large.join(hubs.select("key", F.coalesce("centre", "id").alias("g")), "key").select("g", "id").distinct(), "groups")
            parted = _refine(groups, sets, percent, hold)
            scrap += [groups, parted]
            found = _probed(parted, found, weed, verify, percent, merge, hold, odd)
            rest = _mixed(rest.drop("component", "main", "share"), found, hold)
            scrap.append(rest)
        spelled = rest.where(F.lit(done) | (F.col("c") <= small))
        marks = hold(spelled.groupBy("id").agg(F.collect_set("key").alias("keys")), "marks")
        scrap.append(marks)
        if parities:
            marks = hold(marks.join(joinable(odd, MARKED), "id"), "marks")
            scrap.append(marks)
        across = _crossed(spelled, percent, marks)
        if first is not None:
            across = across.join(first, ["a", "b"], "left_anti")
        if not done:
            across = across.unionByName(_inside(parted, found, percent, odd)).groupBy("a", "b").agg(F.sum("hits").alias("hits"))
        across = hold(across, "across")
        sweep(bands.sparkSession)
        if across.count() <= AT_ONCE:
            found = merge(found, verify(weed(across)))
        else:
            # each item's pair of most shared keys and an eighth of the others go first: what they link needs no more pairs
            each = across.select(F.explode(F.array("a", "b")).alias("x"), "a", "b", "hits")
            best = each.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("hits", -F.col("a"), -F.col("b"))).alias("best")).select("best.*")
            drawn = across.where(F.pmod(F.xxhash64("a", "b"), F.lit(8)) == 0).select("a", "b")
            early = hold(best.union(drawn).distinct(), "early")
            found = merge(found, verify(weed(across.join(early, ["a", "b"])).select("a", "b")))
            found = merge(found, verify(weed(_across(across.join(early, ["a", "b"], "left_anti"), found)).select("a", "b")))
            drop_table(early)
        drop_table(across)
        if done:
            drop_table(*scrap, *links)
            return found
        bands = _finer(parted, found)


#: Sets of a group, picked by hash, that its consensus is read from; it bears on the work only.
SHOWN = 64


def _refine(groups: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, hold: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(g, id, n, most, prefix) of the items of groups (g, id), a written table: what `_finer` and `_inside` build on.

    Let P be the members that at least half of about SHOWN sets of the group share (any P is
    right; this one leaves little).  Linked sets u and m share at least `percent` / (100 + percent) of
    |u| + |m| members.  If they share one outside P, then as each has to share so many
    that lie outside P, the prefixes of both outside parts in hash order have one in common.  If
    not, |u & P| and |m & P| both reach that bound, so neither is larger than `most` of the other.
    """
    sizes = groups.groupBy("g").agg(F.count("*").alias("c"))
    drawn = groups.join(sizes, "g").where(F.pmod(F.xxhash64("id", "g"), F.ceil(F.col("c") / SHOWN)) == 0).select("g", "id")
    drawn = hold(drawn, "drawn")
    shown = drawn.groupBy("g").agg(F.count("*").alias("c"))
    common = drawn.join(sets(drawn.select("id").distinct()), "id").select("g", F.explode("members").alias("e")).groupBy("g", "e").agg(F.count("*").alias("k"))
    common = hold(common.join(shown, "g").where("2 * k >= c").groupBy("g").agg(F.collect_list("e").alias("common")), "common")
    held = groups.join(sets(groups.select("id").distinct()), "id").join(common, "g", "left")
    outside = F.sort_array(F.array_except("members", F.coalesce("common", F.array().cast("array<long>"))))
    parted = held.select("g", "id", F.size("members").cast("long").alias("n"), outside.alias("outside"))
    both = F.col("n") - F.size("outside")
    need = F.greatest(F.ceil((percent * F.col("n") - 100 * both) / 100), F.lit(1)).cast("int")
    most = F.floor(both * (100 + percent) / percent).cast("long") - F.col("n")  # size that a partner inside P can have
    prefix = F.slice("outside", 1, F.greatest(F.size("outside") - need + 1, F.lit(0)))
    parted = hold(parted.select("g", "id", "n", most.alias("most"), prefix.alias("prefix")), "parted")
    drop_table(drawn, common)
    return parted


#: Members of a group's main component that each item outside it is tried with before any pairs are spelled out.
PROBES = 16


def _probed(parted: DataFrame, found: DataFrame, weed: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], percent: int, merge: Callable[[DataFrame, DataFrame], DataFrame], hold: Callable[[DataFrame, str], DataFrame], odd: DataFrame | None) -> DataFrame:
    """Components after the items of `_refine` outside their group's main component were tried with about PROBES members of it, drawn by hash.

    In a dense group nearly all of them link to one of those and need none of their other pairs.
    """
    placed = parted.join(joinable(found, KNOWN), "id", "left").select("g", "id", "n", F.coalesce("component", "id").alias("component"))
    main = placed.groupBy("g", "component").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("component", "c").alias("main"), F.max("c").alias("held"))
    held = hold(placed.join(main, "g"), "named")
    named = _with_bits(held, odd)
    sides = lambda df, s: df.select("g", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "bits") if c in df.columns))
    probes = named.where("component = main").where(F.pmod(F.xxhash64("id", "g"), F.ceil(F.col("held") / PROBES)) == 0)
    tried = sides(named.where("component <> main"), "x").join(sides(probes, "y"), "g").where(_possible(percent, odd is not None))
    tried = hold(tried.groupBy(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).agg(F.count("*").alias("hits")), "tried")
    out = merge(found, verify(weed(tried)))
    drop_table(held, tried)
    return out


def _finer(parted: DataFrame, found: DataFrame) -> DataFrame:
    """Keys (id, n, key, component) of the items of `_refine`, that hold every link over a member outside the consensus."""
    placed = parted.join(found, "id", "left").select("id", "n", "g", F.coalesce("component", "id").alias("component"), F.explode("prefix").alias("e"))
    return placed.select("id", "n", F.xxhash64("g", "e").alias("key"), "component")


def _inside(parted: DataFrame, found: DataFrame, percent: int, odd: DataFrame | None) -> DataFrame:
    """Pairs (a, b, hits) of the items of `_refine` across components that may be linked by the consensus alone, joined on a class of the smaller size."""
    placed = parted.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).where(f"100 * most >= {percent} * n").drop("prefix")
    main = placed.groupBy("g", "component").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("component", "c").alias("main"))
    named = _with_bits(_table(placed.join(main, "g"), "named"), odd)
    step = lambda n: F.floor(F.log(n.cast("double")) * 20).cast("int")
    lesser = named.where("most >= n").withColumn("step", step(F.col("n")))
    steps = F.sequence(step(F.greatest(F.ceil(percent * F.col("n") / 100), F.lit(1))), step(F.greatest(F.least("n", "most"), F.lit(1))))
    larger = named.withColumn("step", F.explode(steps))
    pairs = []
    for lesser_outside in (True, False):
        # one side, at least, lies outside the group's main component
        x = lesser.where("component <> main") if lesser_outside else lesser
        y = larger if lesser_outside else larger.where("component <> main")
        x, y = (side.select("g", "step", *(F.col(k).alias(f"{k}_{s}") for k in ("id", "n", "most", "component", "bits") if k in named.columns)) for side, s in ((x, "x"), (y, "y")))
        joined = x.join(y, ["g", "step"]).where("component_x <> component_y and n_x <= n_y and n_y <= most_x and n_x <= most_y").where(_possible(percent, odd is not None))
        pairs.append(joined.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")))
    return pairs[0].union(pairs[1]).groupBy("a", "b").agg(F.count("*").alias("hits"))


def _most() -> Column:
    """The id with most links among rows with `d`, the smallest of several."""
    return F.max_by("id", F.struct(F.coalesce("d", F.lit(0)), -F.col("id")))


def _degrees(links: list[DataFrame]) -> DataFrame:
    """(id, d): links of each id."""
    return functools.reduce(DataFrame.union, links).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))


def _mixed(members: DataFrame, found: DataFrame, hold: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows of `members`, with their component, under keys that hold several components; `main` is the component with most items there, `share` a row's part of the key's pairs across components."""
    own = members.join(joinable(found, KNOWN), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = own.groupBy("key", "component").agg(F.count("*").cast("double").alias("k"))
    share = (F.sum("k") - F.sum(F.col("k") * F.col("k")) / F.sum("k")) / 2
    mixed = parts.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"), share.alias("share"), F.count("*").alias("held")).where("held > 1").drop("held")
    return hold(own.join(mixed, "key"), "rest")


def _crossing(rest: DataFrame) -> float:
    """How many pairs under one key of `rest` lie in two components; a pair counts under each of its keys."""
    return rest.agg(F.sum("share")).first()[0] or 0


#: Items of up to so many, with all their keys, are broadcast to a join.
MARKED = 1 << 15


def _crossed(rest: DataFrame, percent: int, marks: DataFrame) -> DataFrame:
    """Pairs (a, b, hits) across components under one key of `rest` that their sizes and parities leave possible.

    One end lies outside the key's main component, so what is in that one is never paired with itself; a pair comes from the
    least of its keys alone.  `marks` has (id, keys: all of an item here[, bits]).
    """
    shown = [c for c in ("id", "n", "component", "main", "keys", "bits") if c in rest.columns or c in marks.columns]
    rest = rest.join(joinable(marks, MARKED), "id")
    x, y = (rest.select("key", *(F.col(k).alias(f"{k}_{s}") for k in shown)) for s in "xy")
    joined = x.where("component_x <> main_x").join(y, "key").where("component_x <> component_y and (component_y = main_y or component_x < component_y)")
    joined = joined.where(_possible(percent, "bits" in shown))
    shared = F.array_intersect("keys_x", "keys_y")
    return joined.where(F.array_min(shared) == F.col("key")).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), F.size(shared).cast("long").alias("hits"))


def _with_bits(items: DataFrame, odd: DataFrame | None) -> DataFrame:
    """`items` with their parities, if there are any."""
    return items if odd is None else items.join(joinable(odd, MARKED), "id")


def _possible(percent: int, bits: bool) -> Column:
    """Whether sizes n_x and n_y, and parities bits_x and bits_y if there are any, leave a link possible.

    A bit of the parities of two sets differs only if they differ in a member of its class: so many members, at least, lie in one set alone.
    Longs that are not given tell nothing.
    """
    alike = (100 * F.col("n_x") >= percent * F.col("n_y")) & (100 * F.col("n_y") >= percent * F.col("n_x"))
    if not bits:
        return alike
    apart = functools.reduce(Column.__add__, (F.coalesce(F.bit_count(F.get("bits_x", i).bitwiseXOR(F.get("bits_y", i))), F.lit(0)) for i in range(PARITIES)))
    return alike & ((100 + percent) * apart <= (100 - percent) * (F.col("n_x") + F.col("n_y")))


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that do not lie in one component yet."""
    joined = pairs.join(_named(found, "a", "c_a"), "a", "left").join(_named(found, "b", "c_b"), "b", "left")
    return joined.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b", "hits")


def _merged(found: DataFrame | None, links: DataFrame, few: int | None, rows: int = MANY) -> DataFrame:
    """Components after more links (a, b): only the components that they join meet again."""
    if found is None:
        return components(links, few, rows)
    ends = links.select("a", "b").join(_named(found, "a", "c_a"), "a", "left").join(_named(found, "b", "c_b"), "b", "left")
    roots = components(ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")), few, rows)
    if roots.isEmpty():
        drop_table(roots)
        return found
    moved = found.join(_named(roots, "component", "root"), "component", "left")
    fresh = roots.join(joinable(found.select("id"), KNOWN), "id", "left_anti")
    after = table(moved.select("id", F.coalesce("root", "component").alias("component")).unionByName(fresh), "components", rows)
    drop_table(roots, found)
    return after

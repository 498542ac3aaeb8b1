import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import mixing


def test_targets_are_refilled_until_none_is_above():
    sizes = {"b": 100, "a": 10, None: 1000, "c": 400}
    got = mixing.targets(sizes)  # a: 5, b: 2, c: 1, null: 5
    total = 1.5 * 1510
    assert got["a"] == 20 and got["b"] == 200
    rest = total - 220  # c and null share it 1 : 5
    assert got["c"] == pytest.approx(rest / 6) and got[None] == pytest.approx(rest * 5 / 6)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def brute_flow(patterns, quota, copies):
    """Best (words moved, cost) over all ways to route small patterns."""
    best = (0, 0)
    keys = list(patterns)
    options = []
    for key in keys:
        most = copies * patterns[key]
        options.append([d for d in product(range(most + 1), repeat=len(key)) if sum(d) <= most])
    for choice in product(*options):
        used = Counter()
        for key, split in zip(keys, choice):
            for s, n in zip(key, split):
                used[s] += n
        if all(used[s] <= quota[s] for s in quota):
            moved = sum(map(sum, choice))
            cost = sum(max(0, sum(split) - (k - 1) * patterns[key]) for key, split in zip(keys, choice) for k in range(2, copies + 1))
            best = max(best, (moved, -cost))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_cheapest(seed):
    rng = random.Random(seed)
    sets = [("a",), ("b",), ("a", "b"), ("b", "c"), ("c",)]
    patterns = {s: rng.randrange(3) for s in rng.sample(sets, 3)}
    quota = {s: rng.randrange(5) for s in "abc"}
    flow = mixing.route(patterns, quota)
    moved, cost = sum(flow.values()), sum(max(0, flow[k] - patterns[k]) for k in patterns)
    assert (moved, -cost) == brute_flow(patterns, quota, 2)
    assert all(0 <= flow[k] <= 2 * patterns[k] for k in patterns)


def table(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 5, 30, 200]), [rng.choice(["hot", "hot", "x", "y", None])] + (["z"] if rng.random() < 0.1 else [])) for i in range(n)]
    return spark.createDataFrame(rows, "doc bigint, words int, member array<string>")


def test_taken_words_meet_their_targets(spark):
    df = table(spark)
    how = {"bin_rows": 50}
    found = mixing.mix(df, "doc", F.col("words"), F.col("member"), **how).collect()
    assert sorted((r.id, r.taken) for r in found) == sorted((r.id, r.taken) for r in mixing.mix(df.repartition(7), "doc", F.col("words"), F.col("member"), **how).collect())
    assert len(found) == 3000 and all(r.taken in (0, r.size, 2 * r.size) for r in found)
    sums = Counter()
    for r in df.collect():
        for s in r.member:
            sums[s] += r.words
    quota = mixing.targets(sums)
    patterns = Counter()
    for r in found:
        patterns[tuple(r.pattern)] += r.size
    flow = mixing.route(patterns, quota)
    taken = Counter()
    for r in found:
        taken[tuple(r.pattern)] += r.taken
    assert all(0 <= flow[k] - taken[k] <= 30 for k in flow)
    assert abs(sum(flow.values()) - sum(quota.values())) <= len(quota)


def test_awkward_rows(spark, awkward):
    found = mixing.mix_documents(awkward, "doc_id", "text", "source").collect()
    assert len(found) == awkward.count()
    assert all(r.taken == 0 for r in found if r.size == 0)
    assert [(r.size, r.source_size) for r in found if r.id == 6] == [(1, 1)]
    assert mixing.mix_documents(awkward.limit(0), "doc_id", "text", "source").collect() == []


def least_cut(patterns, quota, names):
    """Most words that can move: the least, over all sets of sources, of their quotas and the patterns not inside."""
    inside = np.zeros(1 << len(names), np.int64)
    for key, n in patterns.items():
        inside[sum(1 << names.index(s) for s in key)] += n
    quotas = np.zeros(1 << len(names), np.int64)
    for i, s in enumerate(names):
        view = inside.reshape(-1, 2, 1 << i)
        view[:, 1] += view[:, 0]
        quotas.reshape(-1, 2, 1 << i)[:, 1] += round(quota[s])
    return int((quotas + sum(patterns.values()) - inside).min())


@pytest.mark.parametrize(("sources", "scale"), [(6, 40), (6, 3), (17, 10)])
def test_flow_is_the_cheapest_with_every_pattern(sources, scale):
    """17 sources have 131,071 patterns; what moves at each cost is what the least cut allows."""
    rng = random.Random(sources * scale)
    names = [f"s{i}" for i in range(sources)]
    patterns = {tuple(s for i, s in enumerate(names) if k >> i & 1): rng.randrange(scale) for k in range(1, 1 << sources)}
    total = sum(patterns.values())
    quota = {s: rng.random() ** 3 * total for s in names}
    flow = mixing.route(patterns, quota)
    once = least_cut(patterns, quota, names)
    twice = least_cut({k: 2 * n for k, n in patterns.items()}, quota, names)
    assert sum(flow.values()) == twice and all(0 <= flow[k] <= 2 * n for k, n in patterns.items())
    first = mixing.route(patterns, quota, 1)
    assert sum(first.values()) == once and all(first[k] <= n for k, n in patterns.items())
    assert sum(max(0, flow[k] - n) for k, n in patterns.items()) == twice - once


def test_many_patterns(spark, monkeypatch):
    """Every row is there, limits and sizes hold, and the plan may be joined by a shuffle."""
    rows = [(i, 1 + i % 7, [f"s{k}" for k in range(6) if i >> k & 1]) for i in range(1, 640)]
    docs = spark.createDataFrame(rows, "id bigint, n bigint, belongs array<string>")
    found = mixing.mix(docs, "id", F.col("n"), F.col("belongs")).collect()
    monkeypatch.setattr(mixing, "MOST", 0)
    again = mixing.mix(docs, "id", F.col("n"), F.col("belongs")).collect()
    assert sorted(r.id for r in found) == [r[0] for r in rows] and sorted(map(repr, found)) == sorted(map(repr, again))
    assert all(r.taken <= 2 * r.size for r in found)
    total = sum(n for _, n, _ in rows)
    assert 1.4 * total < sum(r.taken for r in found)  # a row counts in the size of each of its sources


def test_null_ids_do_not_share_one_place(spark):
    docs = spark.createDataFrame([(None, f"word {i} more", "s") for i in range(20_000)], "doc_id bigint, text string, source string")
    found = mixing.mix_documents(docs, "doc_id", "text", "source")
    assert found.agg(F.sum("taken")).first()[0] in range(89_000, 90_001)

import functools
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tidewell.llm import graph, minhash, queries
from tidewell.llm.hashing import BLANKS, MARKS, pieces, strings, words


def shingle_set(text, width=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def brute(rows, width=3, percent=85):
    """Components by all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def family(rng, base, n, share):
    out = []
    for _ in range(n):
        ws = list(base)
        for k in rng.sample(range(len(ws)), int(share * rng.random() * len(ws))):
            ws[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


def check(spark, documents, rows, p=minhash.HyperMinHash()):
    found = minhash.components_by_hyperminhash(documents(*rows), "doc_id", "text", p).collect()
    want = brute(rows, p.width, p.percent)
    assert {r.id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.id == r.component_id) for r in found)


def test_equals_brute_force_on_families(spark, documents):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for size in (3, 12, 40, 150):
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts += family(rng, base, 12, 0.12) + [" ".join(base), " ".join(base + ["tail"]), " ".join(base[: size * 9 // 10])]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(50)) for _ in range(30)]
    check(spark, documents, list(enumerate(texts)))


@pytest.mark.parametrize("share", [0.05, 0.2])
def test_large_groups_are_refined_without_losing_links(spark, documents, share):
    """A group larger than `small`, with many members on either side of the threshold, and a second group inside it."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    second = list(base)
    for k in range(0, 150, 9):
        second[k] = f"c{k}"
    texts = family(rng, base, 130, share) + family(rng, second, 60, share) + [" ".join(base[:n]) for n in range(118, 150, 4)] + [" ".join(base)]
    check(spark, documents, list(enumerate(texts)))


@pytest.mark.parametrize("p", [minhash.HyperMinHash(), corpus_pipeline.NEAR], ids=["op8", "pipeline"])
def test_groups_are_refined_without_parities(spark, documents, monkeypatch, p):
    """As if more pairs were left at every level than are checked in one go: small tables end before any group is refined."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    second = [f"c{i}" if i % 9 == 0 else w for i, w in enumerate(base)]
    texts = family(rng, base, 60, 0.2) + family(rng, second, 30, 0.2) + [" ".join(base[:n]) for n in range(70, 90, 4)] + [" ".join(base)]
    monkeypatch.setattr(graph, "_crossing", lambda rest: float("inf"))
    monkeypatch.setattr(graph, "AT_ONCE", 0)
    monkeypatch.setattr(minhash, "linked", functools.partial(graph.linked, small=2))
    levels = []
    refine = graph._refine
    monkeypatch.setattr(graph, "_refine", lambda *a: levels.append(1) or refine(*a))
    check(spark, documents, list(enumerate(texts)), p)
    assert levels


def test_widths_and_thresholds(spark, documents):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    check(spark, documents, list(enumerate(family(rng, base, 30, 0.1))), minhash.HyperMinHash(width=5, percent=80, rows=4))


def test_awkward_rows(spark, awkward):
    found = minhash.components_by_hyperminhash(awkward, "doc_id", "text").collect()
    assert len(found) == awkward.count()
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in found if r.id is not None}
    assert got[1] == (3, 1, True) and got[2] == got[3][:0] + (0, 2, True) and got[3] == (0, 3, True) and got[4] == (0, 4, True)
    assert all(r.component_id is None and r.kept for r in found if r.id is None)
    assert minhash.components_by_hyperminhash(awkward.limit(0), "doc_id", "text").collect() == []


def test_equals_sql(agree):
    agree(queries.QUERIES["op8_hyperminhash"], queries.ORACLES["op8_hyperminhash"])


def test_corrected_estimate_is_close():
    rng = np.random.default_rng(1)
    p = minhash.HyperMinHash()
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(30):
            common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) for n in (int(2000 * share), int(1000 * (1 - share)), int(1000 * (1 - share))))
            full = []
            for s in (np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))):
                at, values = minhash.registers(s, p)
                row = np.zeros(128, np.uint16)
                row[at] = values
                full.append((row, len(s)))
            got, _ = minhash.estimate(full[0][0][None], full[1][0][None], np.array([full[0][1]]), np.array([full[1][1]]), p)
            errors.append(got[0] - len(common) / (len(common) + len(a) + len(b)))
        assert abs(np.mean(errors)) < 0.03


def test_register_holds_leading_zeros_and_mantissa():
    p = minhash.HyperMinHash(buckets=4, mantissa=3)
    value = 5 << 60 | 0b0001_101 << 53 | 1  # bucket 5, three zeros, the one, then 101
    at, regs = minhash.registers(np.array([value], np.uint64), p)
    assert at.tolist() == [5] and regs.tolist() == [(3 << 3 | 0b101) + 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAé1 \n\t.-\x1c中"), max_size=12), max_size=6), st.booleans())
def test_vectorised_words(texts, marks):
    data, offsets = strings(pa.array(texts, pa.string()))
    w = words(data, offsets, MARKS if marks else BLANKS)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+" if marks else r"[^\x20\x09-\x0D]+"
    want = [re.findall(pattern, lower(t)) for t in texts]
    assert np.diff(w.rows).tolist() == list(map(len, want))
    flat = [x for row in want for x in row]
    names = dict(zip(flat, w.hashes.tolist()))
    assert [names[x] for x in flat] == w.hashes.tolist() and len(set(names.values())) == len(names)
    assert [bytes(data[s:e]).decode().lower() for s, e in zip(w.starts, w.ends)] == [x.lower() for x in flat]


def test_pieces_cover_rows():
    offsets = np.array([0, 5, 5, 30, 31, 40])
    assert [x for lo, hi in pieces(offsets, 8) for x in range(lo, hi)] == list(range(5))


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(2)
    ids = list(range(400))
    rng.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(150)] + [(ids[200], ids[i]) for i in range(201, 300)] + [(5, 5), (None, 3), (ids[0], ids[1])]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in ids[:151]} == {min(ids[:151])} and {got[i] for i in ids[200:300]} == {min(ids[200:300])}
    assert len(got) == 251
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_stars_and_one_task_agree_on_components(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 130)] + [(129, 5), (7, 7), (None, 3), (300, 200), (200, 300)]
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    want = {**dict.fromkeys(range(10, 41), 10), **dict.fromkeys([5, *range(100, 130)], 5), 200: 200, 300: 200}
    for few in (graph.FEW, 0):
        monkeypatch.setattr(graph, "FEW", few)
        assert {r.id: r.component for r in graph.components(table).collect()} == want


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_no_link_of_short_sets_is_lost(spark, documents, width, percent):
    """Pairs of unions of 2 to 40 shingles, alone with each other; of all that are linked none is missed."""
    rng = random.Random(width)
    rows, want = [], []
    for union in range(2, 41):
        for k in range(12):
            words_ = [f"w{union}x{k}x{i}" for i in range(union + width - 1)]
            other = words_[:-1] if k % 3 == 0 else [*words_[:-1], "else"] if k % 3 == 1 else words_[1:-1]
            doc = 2 * len(want)
            rows += [(doc, " ".join(words_)), (doc + 1, " ".join(other))]
            a, b = shingle_set(rows[-2][1], width), shingle_set(rows[-1][1], width)
            want.append(100 * len(a & b) >= percent * len(a | b))
    rng.shuffle(rows)
    found = {r.id: r.component_id for r in minhash.components_by_hyperminhash(documents(*rows), "doc_id", "text", minhash.HyperMinHash(width=width, percent=percent, rows=4 if width == 5 else 5)).collect()}
    assert [found[2 * i + 1] == 2 * i for i in range(len(want))] == want and 0.3 < sum(want) / len(want) < 0.95


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_linked_short_sets_share_a_key(data):
    p = minhash.HyperMinHash()
    both = data.draw(st.sets(st.integers(1, 2**63), min_size=1, max_size=36))
    extra = [data.draw(st.sets(st.integers(1, 2**63), max_size=6)) - both for _ in range(2)]
    a, b = (np.array(sorted(both | e), np.uint64) for e in (extra[0], extra[1] - extra[0]))
    if 100 * len(both) >= p.percent * len(both | extra[0] | extra[1]) and min(len(a), len(b)) <= p.short and not np.array_equal(a, b):
        keys = minhash.set_keys([a, b], [minhash.band_keys(*minhash.registers(s, p), p) for s in (a, b)], p)
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_ids_of_other_types(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("b", text), ("a", text + " tail"), ("c", "something else here"), (None, text), ("d", None), ("b", text)]
    found = minhash.components_by_hyperminhash(spark.createDataFrame(rows, "name string, text string"), "name", "text").collect()
    assert sorted(map(repr, ((r.id, r.component_id, r.kept) for r in found))) == sorted(map(repr, [("b", "a", False), ("b", "a", False), ("a", "a", True), ("c", "c", True), ("d", "d", True), (None, "a", True)]))
    small = spark.createDataFrame([(2, text), (1, text)], "name int, text string")
    assert {(r.id, r.component_id) for r in minhash.components_by_hyperminhash(small, "name", "text").collect()} == {(1, 1), (2, 1)}


def test_pairs_of_mixed_keys_come_once(spark):
    """A pair under three keys is one row; pairs inside a component, or too far apart in size or parities, are none."""
    own = {1: (10, 1), 2: (10, 1), 3: (10, 3), 4: (10, 4), 5: (30, 5)}
    members = spark.createDataFrame([(k, i, n, 5, 1) for k in (7, 8, 9) for i, (n, _) in own.items()], "key long, id long, n long, c long, p long")
    found = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    rest = graph._mixed(members, found, graph.table)
    assert round(graph._crossing(rest), 6) == 3 * 9
    marks = [(i, [7, 8, 9], [0, 0, 0, 7 if i == 4 else 0]) for i in own]
    marks = graph.table(spark.createDataFrame(marks, "id long, keys array<long>, bits array<long>"), "marks")
    assert sorted(map(tuple, graph._crossed(rest, 80, marks.drop("bits")).collect())) == [(1, 3, 3), (1, 4, 3), (2, 3, 3), (2, 4, 3), (3, 4, 3)]
    assert sorted(map(tuple, graph._crossed(rest, 80, marks).collect())) == [(1, 3, 3), (2, 3, 3)]


def test_components_without_a_python_task(spark):
    """Long chains in order and in disorder, hubs of any rank and a hub below its leaves, by joins alone."""
    rng = random.Random(6)
    mixed = rng.sample(range(1000, 1300), 300)
    edges = [(i, i + 1) for i in range(200)] + list(zip(mixed, mixed[1:])) + [(5000, i) for i in range(4000, 4060)] + [(6000, 6000 + i) for i in range(1, 50)]
    want = {**dict.fromkeys(range(201), 0), **dict.fromkeys(mixed, 1000), **dict.fromkeys([5000, *range(4000, 4060)], 4000), **dict.fromkeys(range(6000, 6050), 6000)}
    found = graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), 0).collect()
    assert {r.id: r.component for r in found} == want and len(found) == len(want)

import random
from itertools import combinations

from pyspark.sql import functions as F

from tidewell.llm import graph, lines, queries


def shingles(line, k=8):
    return {line} if len(line) <= k else {line[i : i + k] for i in range(len(line) - k + 1)}


def brute(rows, percent=80):
    """Removed positions of each document by all pairs of lines."""
    ends = " \t\n\x0b\x0c\r"
    places = [(d, i, line.strip(ends)) for d, t in sorted(rows) for i, line in enumerate((t or "").split("\n")) if line.strip(ends)]
    distinct = sorted({p[2] for p in places})
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(distinct, 2):
        x, y = shingles(a), shingles(b)
        if 100 * len(x & y) >= percent * len(x | y):
            root[find(a)] = find(b)
    first, gone = {}, {d: [] for d, _ in rows}
    for d, i, line in places:
        if first.setdefault(find(line), (d, i)) != (d, i):
            gone[d].append(i)
    return gone


def mutate(rng, line, n):
    chars = list(line)
    for _ in range(n):
        chars[rng.randrange(len(chars))] = rng.choice("qxz")
    return "".join(chars)


def test_equals_brute_force(spark, documents):
    rng = random.Random(4)
    words = ["the", "lantern", "of", "harbour", "signal", "under", "copper", "weather", "and", "slow", "river"]
    line = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    bases = [line(n) for n in (2, 5, 12, 30, 60)]
    pool = [mutate(rng, b, rng.randrange(4)) for b in bases for _ in range(14)] + [line(8) for _ in range(30)] + ["", "  ", "x", "  x ", "short line", "short line."]
    pool += ["中文字符行用来测试没有空格的文字" + c for c in "甲乙丙"] * 2
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    found = {r.id: r for r in lines.dedup_lines(documents(*rows), "doc_id", "text").collect()}
    want = brute(rows)
    assert {i: list(r.removed) for i, r in found.items()} == want
    for i, text in rows:
        parts = text.split("\n")
        assert found[i].text == "\n".join(p for k, p in enumerate(parts) if k not in want[i])
        assert found[i].n_lines == sum(bool(p.strip()) for p in parts) and found[i].n_kept == found[i].n_lines - len(want[i])


def test_a_large_group_of_similar_lines(spark, documents):
    rng = random.Random(8)
    base = " ".join(f"word{i}" for i in range(40))
    rows = [(i, mutate(rng, base, rng.randrange(12))) for i in range(120)]
    found = {r.id: list(r.removed) for r in lines.dedup_lines(documents(*rows), "doc_id", "text").collect()}
    assert found == brute(rows)


def test_awkward_rows(spark, awkward):
    found = lines.dedup_lines(awkward, "doc_id", "text", carry=["removed", "id", "lang"]).collect()
    assert len(found) == awkward.count()
    assert [(r.text, r.n_kept) for r in found if r.id == 1] == [("hello world this is fine", 1)] * 2  # repeated rows share their place
    assert [(r.text, r.n_lines, r.n_kept) for r in found if r.id == 2] == [(None, 0, 0)]
    assert [(r.text, r.n_lines) for r in found if r.id == 4] == [(" \n\t ", 0)]
    assert {r.carried.removed for r in found} == {"r"}
    assert lines.dedup_lines(awkward.limit(0), "doc_id", "text").collect() == []


def test_same_id_with_other_texts(spark, documents):
    found = lines.dedup_lines(documents((1, "first line\nshared"), (1, "shared\nsecond line")), "doc_id", "text").collect()
    assert sorted(r.text for r in found) == ["first line\nshared", "second line"] or sorted(r.text for r in found) == ["first line", "shared\nsecond line"]


def test_short_lines_with_one_small_change_are_candidates(spark):
    rng = random.Random(3)
    pairs = {("Read more now", "Read more now!"), ("aaaaaaaa", "aaaaaaaaaa")}
    while len(pairs) < 1500:
        a = "".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(9, 38)))
        at = rng.choice([0, len(a) - 1, rng.randrange(len(a))])
        b = rng.choice([a + "!", a[:-1], a[:at] + "q" + a[at + 1 :]])
        x, y = shingles(a), shingles(b)
        if a != b and min(len(x), len(y)) <= 24 and 100 * len(x & y) >= 80 * len(x | y):
            pairs.add((a, b))
    p = lines.LineMinHash()
    table = spark.createDataFrame([(i, *pair) for i, pair in enumerate(sorted(pairs))], "id bigint, a string, b string")
    keys = lambda c: lines.with_band_keys(table.select("id", F.col(c).alias("line")), p).withColumnRenamed("keys", c)
    missed = keys("a").join(keys("b"), "id").where(~F.arrays_overlap("a", "b"))
    assert missed.collect() == []


def test_parities_spare_unlike_pairs_and_no_linked_one(spark):
    rng = random.Random(6)
    draw = lambda n: [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
    pairs = []
    for i, (both, alone) in enumerate([(450, 56), (450, 50), (24, 3), (1, 0), (412, 88), (400, 100), (30, 30)] * 20):
        shared = draw(both)
        pairs.append((i, both, alone, shared + draw(alone), shared + draw(alone)))
    bits = []
    for side in (3, 4):
        sets = spark.createDataFrame([(r[0], r[side]) for r in pairs], "id bigint, members array<bigint>")
        bits.append({r.id: r.bits for r in lines.with_parities(sets).collect()})
    rows = [(i, both, alone, both + alone, both + alone, bits[0][i], bits[1][i]) for i, both, alone, _, _ in pairs]
    table = spark.createDataFrame(rows, "id int, shared int, alone int, n_x bigint, n_y bigint, bits_x array<bigint>, bits_y array<bigint>")
    left = {(r.shared, r.alone): r.c for r in table.where(graph._possible(80, True)).groupBy("shared", "alone").agg(F.count("*").alias("c")).collect()}
    linked = [(450, 56), (450, 50), (24, 3), (1, 0)]
    assert all(left[k] == 20 for k in linked)  # 100 * both >= 80 * union
    assert left.get((412, 88), 0) + left.get((400, 100), 0) + left.get((30, 30), 0) <= 2  # similarities of 0.70, 0.67 and 0.33


def test_equals_sql(agree):
    agree(queries.QUERIES["op1_line_dedup"], queries.ORACLES["op1_line_dedup"])

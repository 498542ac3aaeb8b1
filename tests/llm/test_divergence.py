import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import divergence, queries
from tidewell.llm.divergence import Audit


def brute(rows, least=3, top=200):
    """rows: (text, lang, source)."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {x[1] for x in docs}:
        mine = [x for x in docs if x[1] == lang]
        held = Counter(w for ws, _, _ in mine for w in set(ws))
        kept = {w for w, n in held.items() if n >= least}
        by = defaultdict(Counter)
        for ws, _, s in mine:
            by[s].update(w for w in ws if w in kept)
        total = sum(by.values(), Counter())

        def share(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        for a in by:
            pairs = [(sum((share(by[a], w) - share(by[b], w)) ** 2 // share(by[b], w) for w in kept), b) for b in by if b != a]
            terms = [((share(by[a], w) - share(total, w)) ** 2 // share(total, w), w) for w in kept if by[a][w] and share(by[a], w) > share(total, w)]
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, a, part, item, value, i + 1) for i, (value, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def check(docs, rows, **how):
    found = divergence.audit(docs, "text", "lang", "source", Audit(**how)).collect()
    assert sorted(map(tuple, found)) == brute(rows, how.get("least", 3), how.get("top", 200))


def rows_of(*groups):
    return [(t, lang, s) for lang, s, *texts in groups for t in texts]


ROWS = rows_of(
    ("en", "a", "The cat sat", "the dog sat", "the cat ran", "THE end"), ("en", "b", "a dog ran", "dog DOG dog é É", "dog ran é", None), ("en", "c", "", "123 4.5"), ("en", None, "cat é", "sat"),
    ("de", "a", "nur hier", "nur da"), ("de", "b", "ganz anders"), (None, "a", "the the the", "the cat", "the"), (None, None, None), ("fr", "z", "alone alone", "alone", "alone"),
)


def test_cases(documents):
    docs = documents(*((i, *r) for i, r in enumerate(ROWS)))
    check(docs, ROWS)
    check(docs, ROWS, least=1, top=2)
    check(docs, ROWS, least=1, groups=1, terms=2, slab=1)  # many tiles, chunks and slabs
    check(docs, ROWS, least=1, groups=2, terms=3, slab=2)
    check(docs.limit(0), [])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("abAé 中😀1_"), max_size=30), st.sampled_from(["x", "y"]), st.sampled_from("pqrst")), max_size=40))
def test_any_tables(spark, rows):
    check(spark.createDataFrame(rows, "text string, lang string, source string"), rows, least=2, groups=2, terms=4, slab=1)


def test_long_text_and_repeated_rows(documents):
    rows = [("word%s " % "abc" * 30_000, "en", "a"), ("x " * 50_000 + "y", "en", "b")] + [("x y z", "en", "a")] * 5
    check(documents(*((1, *r) for r in rows)), rows)


def test_division_is_exact():
    rng = np.random.default_rng(3)
    for total in (1, 7, 10**6 + 3, 4 * 10**12 + 1, 8 * 10**15):
        counts = np.concatenate([[0], rng.integers(0, total, 50)])
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_share_in_sql_is_exact(spark):
    from pyspark.sql import functions as F

    rows = [(c, t) for t in (10, 10**6 + 3, 4 * 10**13 + 1) for c in (0, 1, t // 3, t - 1)]
    found = spark.createDataFrame(rows, "c bigint, t bigint").select("c", "t", divergence.share(F.col("c"), F.col("t")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.t for r in found.collect())


def test_equals_sql(agree):
    assert agree(queries.QUERIES["op11_tiled_divergence"], queries.ORACLES["op11_tiled_divergence"])

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import decontam, queries

ITEMS = "item_id bigint, text string, id int"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    ws, hit, names = split(text), set(), set()
    for key, other in items:
        own = split(other)
        size = min(window, len(own))
        wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(ws) - size + 1):
            if size and key is not None and tuple(ws[i : i + size]) in wanted:
                hit |= set(range(i, i + size))
                names.add(str(key))
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


def check(spark, documents, docs, items, **how):
    found = decontam.digest(decontam.contamination(documents(*docs), spark.createDataFrame([(*i, 1) for i in items], ITEMS), "doc_id", "text", "item_id", "text", **how)).collect()
    want = [(d, *brute(t, items)) for d, t in docs]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"


def test_cases(spark, documents):
    items = [(1, PASSAGE), (2, "short item"), (10, "one"), (3, None), (4, " .,; "), (None, "no id"), (2, "short thing"), (11, PASSAGE + " tau")]
    docs = [
        (1, "Before. " + PASSAGE.upper() + " after"), (2, PASSAGE.replace(" kappa", ", kappa\n")), (3, " ".join(PASSAGE.split()[:12])), (4, " ".join(PASSAGE.split()[2:15])),
        (5, "a Short, ITEM here"), (6, "one"), (7, None), (8, ""), (9, "?!"), (None, "short item"), (1, "short thing"), (12, "filler " * 3000 + PASSAGE), (13, ("x " * 40 + PASSAGE + " ") * 300),
    ]
    check(spark, documents, docs, items)
    check(spark, documents, docs, items, block_bytes=30)  # many blocks
    check(spark, documents, docs, [])
    check(spark, documents, [], items)


def test_windows_do_not_cross_rows(spark, documents):
    words = PASSAGE.split()
    check(spark, documents, [(i, w) for i, w in enumerate(words)] + [(50, " ".join(words[:7])), (51, " ".join(words[7:]))], [(1, PASSAGE)])


def test_spans(spark, documents):
    items = spark.createDataFrame([(1, "b c", 1)], ITEMS)
    row = decontam.contamination(documents((1, "a b c d b c e")), items, "doc_id", "text", "item_id", "text").first()
    assert [tuple(s) for s in row.spans] == [(1, 3), (4, 6)] and row["items"] == ["1"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 4))
def test_scanner_finds_all(patterns, text, window):
    import numpy as np
    import pyarrow as pa

    from tidewell.llm.hashing import MARKS, strings, words

    data, offsets = strings(pa.array([" ".join(text)], pa.string()))
    w = words(data, offsets, MARKS)
    found = np.zeros(len(text), bool)
    for s in decontam.scanners([(i, " ".join(p)) for i, p in enumerate(patterns)], window):
        for at, _ in s.search(w, data):
            found[at : at + s.length] = True
    want = np.zeros(len(text), bool)
    for p in patterns:
        size = min(window, len(p))
        for j in range(len(p) - size + 1):
            for i in range(len(text) - size + 1):
                if text[i : i + size] == p[j : j + size]:
                    want[i : i + size] = True
    assert found.tolist() == want.tolist()


def test_equals_sql(agree):
    agree(queries.QUERIES["op5_wu_manber"], queries.ORACLES["op5_wu_manber"])

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import infill, queries


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=3000))
def test_rank_and_select(bits):
    bits = np.array(bits, bool)
    vector, ones = infill.Bits(bits), np.flatnonzero(bits)
    at = np.arange(len(bits) + 1)
    assert vector.rank(at).tolist() == [0, *np.cumsum(bits).tolist()]
    assert vector.select(np.arange(len(ones))).tolist() == ones.tolist()


def test_rank_and_select_over_many_blocks():
    rng = np.random.default_rng(1)
    for share in (0.0001, 0.01, 0.99):
        bits = rng.random(200_000) < share
        ones = np.flatnonzero(bits)
        vector = infill.Bits(bits)
        assert (vector.select(np.arange(len(ones))) == ones).all() and (vector.rank(ones) == np.arange(len(ones))).all()


def brute(doc, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(docs, rows, **how):
    found = infill.infill(docs, "doc_id", "text", infill.Infill(**how)).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in found))) == sorted(map(repr, [(d, *brute(d, t, **how)) for d, t in rows]))
    assert sorted(r.back for r in found) == sorted(t or "" for _, t in rows)


def test_cases(documents):
    long = "".join(f"line {i} é中\n" for i in range(150_000))
    rows = [(i, t) for i, t in enumerate(["a", "\n", "\n\n\n", "a\nb", "a\nb\n", "é\n中\n😀", "<P>", "a<S>\nb", "x <M", ">\n<", "P>\n<S\n>", "no end\nat all", long, None, "", " ", "<<\n<P\n", "a\r\nb\r\n"])]
    rows += [(None, "null\nid\n"), (None, None), (1, "a"), (1, "a"), (-5, "minus\nfive\n")]
    check(documents(*rows), rows)
    check(documents(*rows), rows, seed=9, rate=40, spm=10)
    check(documents(), [])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\n<PSM>é"), max_size=30), max_size=40))
def test_any_texts(spark, texts):
    rows = list(enumerate(texts))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_string_ids(spark):
    found = infill.infill(spark.createDataFrame([("k1", "a\nb\n", 1)], "name string, body string, n int"), "name", "body").first()
    assert found.id == "k1" and (found.n, found.form, found.prefix_chars, found.middle_chars, found.output) == brute("k1", "a\nb\n")


def test_equals_sql(agree):
    assert {r[0] for r in agree(queries.QUERIES["op12_rank_select_infill"], queries.ORACLES["op12_rank_select_infill"])}

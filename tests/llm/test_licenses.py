import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import licenses, queries
from tidewell.llm.licenses import BASE, TEMPLATES, Template


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, given=TEMPLATES, k=3):
    ws = split(text)
    base = [(i, label) for p, label in BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    spans = []
    for t in given:
        ts = t.words()
        met = sorted((a - b, a, b) for a in range(len(ws) - k + 1) for b in range(len(ts) - k + 1) if ws[a : a + k] == ts[b : b + k])
        islands = []
        for m in met:
            if not islands or (m[0] - islands[-1][-1][0]) * 5 > len(ts):
                islands.append([])
            islands[-1].append(m)
        for island in islands:
            covered = {b + j for _, _, b in island for j in range(k)}
            start, end = min(a for _, a, _ in island), max(a for _, a, _ in island) + k
            if 100 * len(covered) >= 85 * len(ts) and set(t.needed()) <= covered and 2 * (end - start) <= 3 * len(ts):
                spans.append((start, end, t.label, len(covered) / len(ts)))
    at = [i for i, _ in base]
    labels = {x for _, x in base}
    return len(ws), len(base), min(at, default=None), max(at, default=None), sorted(labels), sorted(spans), sorted(labels | {s[2] for s in spans}), max((s[3] for s in spans), default=0.0)


def check(spark, documents, rows, given=TEMPLATES):
    found = licenses.scan(documents(*rows), "doc_id", "text", given).collect()
    got = [(r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, [tuple(s) for s in r.spans or []], r.labels, r.score) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, [(d, *brute(t, given)) for d, t in rows]))
    return {r.id: r for r in found}


LONG = TEMPLATES[2].text


def test_cases(spark, documents):
    w = LONG.split()
    rows = [
        (1, "x Released under the MIT License. y"), (2, "licensed under CC BY-NC 4.0, all rights reserved"), (3, "Licensed under CC BY 4.0"), (4, "the GNU General Public License"),
        (5, None), (6, ""), (7, "..."), (None, "All rights reserved"), (None, None), (1, "general public license cc by cc by"), (1, "general public license cc by cc by"),
        (8, "filler " * 5000 + LONG + " filler" * 5000 + LONG), (9, " ".join(w[:20] + ["added", "words"] + w[20:])), (10, " ".join(w[:12])), (11, " ".join(w[3:])), (12, " ".join([*w[:15], *w[17:]])),
        (13, "licensed under the mit " * 40), (14, "Licensed under CC BY-SA"), (15, "É cc É by"),
    ]
    found = check(spark, documents, rows)
    assert found[1] and found[9].labels == ["mit"] and found[12].labels == ["mit"] and found[10].labels == []
    assert found[3].labels == ["cc-by"] and found[14].labels == ["cc-by", "cc-by-sa"]
    assert len(found[8].spans) == 2 and found[8].score == 1.0
    check(spark, documents, [])
    check(spark, documents, [(1, "nothing here"), (2, None)])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d e x".split()), max_size=40).map(" ".join), min_size=3, max_size=8))
def test_any_texts(spark, texts):
    given = (Template("l1", "a b c d e"), Template("l2", "a b a b c d e d c b", "d"), Template("l3", "x a x"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = licenses.scan(docs, "doc_id", "text", given).collect()
    assert sorted((r.id, sorted(map(tuple, r.spans or [])), r.labels, r.score) for r in found) == [(i, brute(t, given)[5], brute(t, given)[6], brute(t, given)[7]) for i, t in enumerate(texts)]


def test_many_templates_meet_in_a_shuffled_join(spark, documents, monkeypatch):
    monkeypatch.setattr(licenses, "MOST", 0)
    check(spark, documents, [(1, "released under the MIT license"), (2, LONG), (3, "cc by")])


def test_no_python_on_executors(spark, awkward):
    voted = licenses.votes(awkward.select(F.col("doc_id").alias("id"), "text"), TEMPLATES)
    for found in (licenses.spans(voted, TEMPLATES), licenses.scan(awkward, "doc_id", "text")):
        assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().executedPlan().toString())
    assert licenses.scan(awkward, "doc_id", "text").count() == awkward.count()


def test_equals_sql(agree):
    rows = agree(queries.QUERIES["op13_license_diagonals"], queries.ORACLES["op13_license_diagonals"])
    assert len({r[4] for r in rows}) > 3

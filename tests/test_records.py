import hashlib
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.functions import canonical, keys
from tidewell.functions import text as tx
from tidewell.operators import chains, contract, scan

# --- chains


def brute_walk(pages, start):
    held = {}
    for cursor, before, hit in pages:
        old = held.get(cursor, (None, False))
        befores = [b for b in (old[0], before) if b is not None]
        held[cursor] = (min(befores, default=None), old[1] or hit)
    at, n, seen = start, 0, set()
    while True:
        if at not in held:
            return ("missing", at, n)
        if at in seen:
            return ("endless", None, None)
        seen.add(at)
        n += 1
        before, hit = held[at]
        if hit or before is None:
            return ("found" if hit else "exhausted", at, n)
        at = before


@pytest.mark.parametrize("seed", range(3))
def test_chains_are_walked_to_the_first_match(spark, seed):
    rng = random.Random(seed)
    pages, starts, want = [], [], []
    for chain in [*range(12), None]:
        n = rng.choice([1, 2, 5, 40])
        mine = [(i, i - 1 if i else None, rng.random() < 0.05) for i in range(n)]
        kind = rng.randrange(4)
        if kind == 1:
            mine[0] = (0, 999, False)  # leads nowhere
        if kind == 2:
            mine[0] = (0, n - 1, False)  # a ring
        mine += rng.sample(mine, min(2, n))
        pages += [(chain, *p) for p in mine]
        for start in {n - 1, rng.randrange(n), 500}:
            starts.append((chain, start))
            want.append((chain, *brute_walk(mine, start)))
    table = spark.createDataFrame(pages, "chain int, cursor int, before int, hit boolean")
    found = chains.walk(table, spark.createDataFrame(starts * 2, "chain int, cursor int"), "chain", "cursor", "before", F.col("hit"))
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_empty_chains_and_limits(spark):
    pages = spark.createDataFrame([("a", i, i - 1 if i else None, False) for i in range(9)], "chain string, cursor int, before int, hit boolean")
    starts = pages.where("cursor = 8").select("chain", "cursor")
    assert tuple(chains.walk(pages, starts, "chain", "cursor", "before", F.col("hit"), most=4).first()) == ("a", "limit", None, 9)
    assert chains.walk(pages.limit(0), starts, "chain", "cursor", "before", F.col("hit")).first().status == "missing"
    assert chains.walk(pages, starts.limit(0), "chain", "cursor", "before", F.col("hit")).collect() == []


# --- prefixes


def test_prefixes_find_none_one_or_several(spark):
    hashes = ["abcdef0" + "1" * 33, "abcdef0" + "2" * 33, "1234567" + "8" * 33, "ABCDEF1" + "0" * 33]
    shorts = ["abcdef0", "ABCDEF01", "1234567", "12345678", "1234567" + "8" * 33, "1234569", "123456", "", None, "abcdef1", "abcdef1"]
    found = scan.resolved(spark.createDataFrame([(s,) for s in shorts], "short string"), "short", spark.createDataFrame([(h,) for h in [*hashes, hashes[0], None]], "oid string"), "oid")
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())
    got = {r.short: (r.oid, r.matches) for r in found.collect()}
    for s in {s.lower() for s in shorts if s is not None}:
        hits = [h.lower() for h in hashes if len(s) >= 7 and h.lower().startswith(s)]
        assert got.pop(s) == ((hits[0], "one") if len(hits) == 1 else (None, "ambiguous" if hits else "none"))
    assert not got


def test_many_prefixes_and_hashes_of_one_head_meet_without_pairs(spark):
    """600 hashes and as many prefixes share their first digits: 360,000 pairs if they met by these."""
    hashes = ["abcdef0" + hashlib.sha1(str(i).encode()).hexdigest()[: 1 + i % 33] for i in range(600)] + ["abcdef0é", "abcdef0éa", "\U0001f600" * 7 + "x"]
    shorts = [h[: 5 + i % 9] for i, h in enumerate(hashes)] + [h + "0" for h in hashes[:50]] + ["abcdef0é", "abcdef0\uffff", "\U0001f600" * 7]
    found = scan.resolved(spark.createDataFrame([(s,) for s in shorts], "short string"), "short", spark.createDataFrame([(h,) for h in hashes], "oid string"), "oid")
    assert not re.search("Join|Cartesian", found._jdf.queryExecution().executedPlan().toString())
    got = {r.short: (r.oid, r.matches) for r in found.collect()}
    want = {}
    for s in set(shorts):
        hits = {h for h in hashes if len(s) >= 7 and h.startswith(s)}
        want[s] = (hits.pop(), "one") if len(hits) == 1 else (None, "ambiguous" if hits else "none")
    assert got == want and {m for _, m in got.values()} == {"one", "none", "ambiguous"}


def test_comments_name_heads_by_prefix(spark):
    full = {k: hashlib.sha1(k.encode()).hexdigest() for k in "abcd"}
    heads = spark.createDataFrame([(k, v) for k, v in full.items()], "name string, head string")
    said = [("bot[bot]", f"clean at {full['a'][:9]}"), ("bot", f"clean at {full['b'].upper()}"), ("else", f"clean at {full['c']}"), ("bot", f"open at {full['d']}")]
    found = scan.commented_among(heads, spark.createDataFrame(said, "author string, body string"), "bot", "^clean", r"\b([0-9a-fA-F]{7,40})\b", heads, "head")
    assert sorted(r.name for r in found.collect()) == ["a", "b"]


# --- contracts

GOOD = {
    "schema_version": "1", "bundle_id": "b", "created": "2024-01-01T00:00:00.5+01:00", "source": {"kind": "local", "ref": "r", "title": None, "duration_s": 1, "published": "2024-01-01T00:00:00Z"},
    "stages": {"acquire": {"state": "done", "outputs": [{"path": "p", "sha256": "s", "bytes": 3}], "error": None}, "visual": {}},
}


def altered(change):
    doc = json.loads(json.dumps(GOOD))
    change(doc)
    return json.dumps(doc)


CASES = [
    (lambda d: None, []),
    (lambda d: d.pop("bundle_id"), [("$.bundle_id", "required")]),
    (lambda d: d.update(bundle_id=None), [("$.bundle_id", "type")]),
    (lambda d: d.update(bundle_id=5, created="soon"), [("$.bundle_id", "type"), ("$.created", "format")]),
    (lambda d: d.update(created="2024-13-01T00:00:00Z"), [("$.created", "format")]),
    (lambda d: d.update(source=[]), [("$.source", "type")]),
    (lambda d: d["source"].update(kind="tape", title=3), [("$.source.kind", "enum"), ("$.source.title", "anyOf")]),
    (lambda d: d["stages"].update(odd={}), [("$.stages.odd", "propertyNames")]),
    (lambda d: d["stages"]["acquire"].update(state="gone", outputs=[{"path": "p", "sha256": "s", "bytes": 1.5}, 7]), [("$.stages.acquire.outputs[0].bytes", "type"), ("$.stages.acquire.outputs[1]", "type"), ("$.stages.acquire.state", "enum")]),
    (lambda d: d["stages"]["acquire"]["outputs"][0].update(bytes=2.0), []),
    (lambda d: d["stages"]["acquire"]["outputs"][0].update(bytes=True), [("$.stages.acquire.outputs[0].bytes", "type")]),
    (lambda d: d.update(more="allowed"), []),
]


def test_manifests_are_held_to_the_contract(spark):
    rows = [(i, altered(change)) for i, (change, _) in enumerate(CASES)] + [(90, "{"), (91, "[]"), (92, None), (93, "null")]
    found = contract.check(spark.createDataFrame(rows, "id int, doc string"), "id", "doc", schemas.manifest_contract())
    got = sorted((r.id, r.path, r.rule) for r in found.collect())
    want = [(i, *v) for i, (_, vs) in enumerate(CASES) for v in vs] + [(90, "$", "json"), (91, "$", "type"), (92, "$", "json"), (93, "$", "type")]
    assert got == sorted(want)


def test_each_value_is_taken_out_once(spark):
    """Every level asked for the values below it, and for their shapes, several times anew, so that the calls of the expression multiplied."""
    inner = {"type": "object", "properties": {"c": {"type": ["integer", "null"]}, "d": {"type": "string", "enum": ["x"]}}}
    schema = {"type": "object", "required": ["a", "z"], "properties": {"a": {"type": "object", "properties": {"b": inner}}}}
    docs = ['{"a": {"b": {"c": 1, "d": "x"}}, "z": null}', '{"a": {"b": {"c": "1", "d": 2}}, "z": 0}', '{"a": {"b": []}, "z": {}}', "{}", '{"a": null, "z": 1}']
    found = contract.check(spark.createDataFrame(list(enumerate(docs)), "id int, doc string"), "id", "doc", schema)
    assert sorted((r.id, r.path, r.rule) for r in found.collect()) == [(1, "$.a.b.c", "type"), (1, "$.a.b.d", "type"), (2, "$.a.b", "type"), (3, "$.a", "required"), (3, "$.z", "required"), (4, "$.a", "type")]
    calls = str(contract.violations(F.col("v"), schema))
    assert calls.count("schema_of_variant") == 2 and calls.count("try_variant_get") < 12


def test_names_that_differ_in_case_and_odd_names(spark):
    schema = {"type": "object", "required": ["a", "A"], "properties": {"a": {"type": "string"}, "A": {"type": "boolean"}, "q`.x": {"type": "object", "properties": {"o`.p": {"type": "null"}}, "additionalProperties": False}}}
    docs = ['{"a": "s", "A": true}', '{"a": true}', '{"A": 1, "q`.x": {"o`.p": 1, "r": 2}}', "[]"]
    found = contract.check(spark.createDataFrame(list(enumerate(docs)), "id int, doc string"), "id", "doc", schema)
    assert sorted((r.id, r.path, r.rule) for r in found.collect()) == [(1, "$.A", "required"), (1, "$.a", "type"), (2, "$.A", "type"), (2, "$.a", "required"), (2, "$.q`.x.o`.p", "type"), (2, "$.q`.x.r", "additionalProperties"), (3, "$", "type")]


def test_other_rules(spark):
    schema = {
        "type": "object", "additionalProperties": False,
        "properties": {"n": {"type": ["integer", "null"], "minimum": 1, "maximum": 9}, "s": {"type": "string", "minLength": 2, "pattern": "^a"}, "l": {"type": "array", "minItems": 1, "items": {"type": "boolean"}}, "c": {"const": "x"}},
    }
    docs = ['{"n": 0, "s": "b", "l": [], "c": "y", "z w": 1}', '{"n": 10, "s": "ab", "l": [true, 0], "c": "x"}', '{"n": null}', "{}"]
    found = contract.check(spark.createDataFrame(list(enumerate(docs)), "id int, doc string"), "id", "doc", schema)
    assert sorted((r.id, r.path, r.rule) for r in found.collect()) == sorted(
        [(0, "$.n", "minimum"), (0, "$.s", "minLength"), (0, "$.s", "pattern"), (0, "$.l", "minItems"), (0, "$.c", "const"), (0, "$.z w", "additionalProperties"), (1, "$.n", "maximum"), (1, "$.l[1]", "type")]
    )


# --- canonical JSON

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**25), 10**25) | st.floats() | st.text(st.characters(exclude_categories=["Cs"]), max_size=8),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(max_size=5).filter(lambda s: s.isprintable()), inner, max_size=4), max_leaves=12,
)


@settings(max_examples=15, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=20))
def test_canonical_bytes_are_pythons(spark, values):
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, v in enumerate(values)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, doc string")
    got = {r.id: (r.a, r.b) for r in rows.select("id", canonical.canonical("doc").alias("a"), canonical.canonical("doc", compact=False, ascii_only=False).alias("b")).collect()}
    for i, v in enumerate(values):
        assert got[i] == (json.dumps(v, sort_keys=True, separators=(",", ":")), json.dumps(v, sort_keys=True, ensure_ascii=False))


def test_canonical_cases():
    assert canonical.encode('{"b": 1, "a": NaN, "b": 2.50}') == '{"a":NaN,"b":2.5}'
    assert [canonical.encode(t) for t in (None, "", "{", "1 2", "[" * 100_000)] == [None] * 5


def test_identity_of_a_command(spark):
    argv = ["tool", "--in", "{input}"]
    said = {"segments": [{"id": 0, "start_s": 0.0, "end_s": None, "text": "é", "source": "local_command"}], "text": "é"}
    digest = lambda v, **how: hashlib.sha256(json.dumps(v, sort_keys=True, **how).encode()).hexdigest()
    want = digest({"method": "local_command_json", "command_sha256": digest({"method": "local_command_json", "argv": argv}), "transcript_sha256": digest(said)}, separators=(",", ":"))
    row = spark.createDataFrame([("é", [(0, 0.0, None, "é", "local_command")])], "text string, segments array<struct<id:int,start_s:double,end_s:double,text:string,source:string>>")
    assert row.select(keys.command_identity(argv, F.struct("text", "segments"))).first()[0] == want


# --- distances of words


def quadratic(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=90), st.lists(st.sampled_from("abcde"), max_size=90))
def test_distance_is_that_of_the_table(a, b):
    assert tx.distance(a, b) == quadratic(a, b)


def test_accuracy_of_long_texts_is_that_of_short_ones(spark):
    rows = [("a b c", "a c"), ("", ""), ("", "x"), ("x", ""), (None, "x"), ("a  b\n", "a b"), ("a", "b c d e")]
    found = spark.createDataFrame(rows, "r string, c string").select("r", tx.word_accuracy("r", "c").alias("one"), tx.word_accuracy_of_long_texts("r", "c").alias("two")).collect()
    assert all(x.one == x.two for x in found if x.r is not None) and [x.two for x in found if x.r is None] == [0.0]
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    one = spark.createDataFrame([(long, long.replace("w7 ", ""))], "r string, c string").select(tx.word_accuracy_of_long_texts("r", "c")).first()[0]
    assert one == 1 - 6 / 30_000


def test_document_accuracy_query(spark, sf):
    from tidewell.plans.state import document_accuracy

    docs = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in document_accuracy(spark, sf).collect():
        words = docs[r.doc_id]
        if len(words) < 400:
            assert r.accuracy == max(0.0, 1 - quadratic(words, [w for i, w in enumerate(words) if i % 7 != 6]) / len(words))


# --- names and payloads


def test_titles_are_pythons(spark):
    names = ["my_talk-on x1y.final.mp4", "it's_a.wav", "ÉCOLE_élève.mp3", "中a_b.wav", "_x.wav", "a.b_c.d", "noSuffix", "", ".hidden", "x--y__z.ogg", "3rd_place.wav"]
    found = spark.createDataFrame([(n,) for n in names], "n string").select("n", tx.title("n").alias("t")).collect()
    for r in found:
        head, dot, _ = r.n.rpartition(".")
        assert r.t == (head if dot and head else r.n).replace("_", " ").title()


def test_payloads_that_only_some_parsers_take(spark):
    from tidewell.operators import segments

    rows = [("a", '{"segments": [{"start_s": 0, "text": "x", "text": "y"}], "confidence": NaN}'), ("b", '{"segments": [{"start_s": NaN, "text": "x"}]}'), ("c", "{"), ("d", None)]
    table = spark.createDataFrame(rows, "k string, p string").select("k", F.coalesce(canonical.lenient("p"), F.col("p")).alias("p"))
    got = {r.k: (r.status, r.text) for r in segments.validate(table, "k", "p").collect()}
    assert got == {"a": ("ok", "y"), "b": ("start_not_a_number", None), "c": ("not_json", None), "d": ("not_json", None)}


def test_state_preflight(spark, tmp_path):
    from tidewell.store import Store, preflight

    row = preflight(spark, f"file://{tmp_path}/a/b/c").first()
    assert (row.exists, row.writable_location, row.schema_version, row.ok) == (False, True, None, True) and not (tmp_path / "a").exists()
    Store(spark, f"file://{tmp_path}/s")
    assert preflight(spark, f"file://{tmp_path}/s").first().schema_version == schemas.STATE_VERSION
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "version.000000000000").write_text("999")
    assert not preflight(spark, f"file://{tmp_path}/t").first().ok
    (tmp_path / "file").write_text("x")
    assert not preflight(spark, f"file://{tmp_path}/file/below").first().writable_location

import json

from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.operators import documents, library, queue, scan, segments, snapshot


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def listing(spark, *items):
    return spark.createDataFrame(list(items), "path string, sha256 string, size_bytes bigint")


def test_lifecycle_of_a_file(spark):
    """Added, unchanged, changed, removed, and added again, with its creation time kept."""
    state = listing(spark).withColumns({"present": F.lit(True), "created_at": F.lit(0), "updated_at": F.lit(0)})
    seen = []
    for now, items in enumerate([[("a", "x", 1)], [("a", "x", 1)], [("a", "y", 1)], [], [], [("a", "y", 1)]], 1):
        current = listing(spark, *items)
        seen.append([r.delta for r in snapshot.diff(state, current, ["path"], ["sha256", "size_bytes"]).collect()])
        state = spark.createDataFrame(
            snapshot.merge(state, current, ["path"], F.lit(now)).collect(), "path string, sha256 string, size_bytes bigint, present boolean, created_at int, updated_at int"
        )
    assert seen == [["added"], ["unchanged"], ["changed"], ["removed"], [], ["added"]]
    assert [(r.present, r.created_at, r.updated_at) for r in state.collect()] == [(True, 1, 6)]


def test_diff_of_empty_tables(spark):
    none = listing(spark)
    assert snapshot.diff(none.withColumn("present", F.lit(True)), none, ["path"], ["sha256"]).collect() == []


def test_enqueue_once_and_policies(spark):
    have = spark.createDataFrame([("q1",)], ["queue_id"])
    new = spark.createDataFrame([("q1",), ("q2",), ("q2",)], ["queue_id"])
    assert rows(queue.enqueue_once(new, have, "queue_id"), "queue_id") == [("q2",)]
    delta = spark.createDataFrame([("a", "s1", "added"), ("b", "s2", "added"), ("c", "s3", "changed"), ("d", "s3", "removed")], "id string, source_id string, delta string")
    sources = spark.createDataFrame([("s1", "disabled"), ("s2", "scan-only"), ("s3", "review")], "source_id string, policy string")
    assert [r.id for r in queue.gate(delta, sources).collect()] == ["c"]


def test_fold(spark):
    events = [
        ("a", 1, "enqueue", None, None), ("a", 2, "fail", "bad", None), ("a", 3, "fail", "worse", None),
        ("b", 4, "fail", "bad", None), ("b", 5, "retry", None, None), ("b", 6, "complete", None, "b1"), ("b", 7, "skip", None, None),
        ("c", 8, "enqueue", None, None),
    ]
    found = queue.fold(spark.createDataFrame(events, "id string, seq bigint, event string, error string, bundle_id string"), "id", "seq")
    assert rows(found.drop("first_seen", "last_seen"), "id") == [("a", "failed", 2, "worse", None), ("b", "skipped", 1, None, "b1"), ("c", "discovered", 0, None, None)]


def test_find_prefers_the_id(spark):
    sources = spark.createDataFrame([("s1", "s2"), ("s2", "talks")], ["id", "name"])
    assert queue.find(sources, "s2").first().name == "talks"
    assert queue.find(sources, "talks").first().id == "s2"
    assert queue.find(sources, "none").collect() == []


def test_claims(spark):
    claims = spark.createDataFrame([("b", 2), ("b", 1), ("c", 3), ("c", 5), ("d", 4)], "bundle_id string, item int")
    owned = spark.createDataFrame([("c", 5), ("d", 9)], "bundle_id string, owner int")
    found = library.claim(claims, "bundle_id", ["item"], owned)
    assert rows(found, "item") == [("b", 1, "completed"), ("b", 2, "failed"), ("c", 3, "failed"), ("d", 4, "failed"), ("c", 5, "refreshed")]


def test_constraints(spark):
    df = spark.createDataFrame([("a", "s"), ("a", "t"), ("b", None)], "id string, parent string")
    parents = spark.createDataFrame([("s",)], ["id"])
    assert rows(schemas.repeated(df, "id"), "id") == [("a", 2)]
    assert [r.parent for r in schemas.orphans(df, "parent", parents, "id").collect()] == ["t"]
    assert schemas.strange(df, "parent", ["s", "t"]).count() == 1
    assert [schemas.version_status(v) for v in (None, 0, 1, 999)] == ["fresh", "fresh", "ok", "unsupported"]


def test_manifests_round_trip(spark, tmp_path):
    folder = tmp_path / "lib" / "talk-1"
    folder.mkdir(parents=True)
    done = {"state": "done", "outputs": [{"path": "source.json", "sha256": "ab", "bytes": 3}]}
    (folder / "manifest.json").write_text(json.dumps({"schema_version": "1.0.0", "bundle_id": "talk-1", "source": {"kind": "local", "ref": "a.wav"}, "stages": {"acquire": done}}, indent=2))
    found = documents.read(spark, str(tmp_path / "lib"))
    assert found.schema == schemas.MANIFEST
    full = found.withColumn("stages", documents.with_all_stages(F.col("stages")))
    out = rows(documents.outputs(full), "stage")
    assert len(out) == 8 and out[0] == ("talk-1", "acquire", "done", "source.json", "ab", 3)
    assert {r[2] for r in out[1:]} == {"pending"}
    assert documents.routed(found).first().readable
    assert not documents.routed(found, "2.0.0").first().readable


def test_stage_and_output_replacement(spark):
    df = spark.sql("select map('a', 1, 'b', 2) m, array(named_struct('path','p','sha256','x','bytes',1L), named_struct('path','q','sha256','y','bytes',2L)) o")
    got = df.select(documents.with_stage(F.col("m"), "b", F.lit(5)), documents.with_output(F.col("o"), "q", F.lit("z"), F.lit(9).cast("bigint"))).first()
    assert got[0] == {"a": 1, "b": 5}
    assert [tuple(x) for x in got[1]] == [("p", "x", 1), ("q", "z", 9)]


def test_integrity(spark):
    recorded = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], ["path", "sha256"])
    actual = spark.createDataFrame([("a", "1"), ("b", "x")], ["path", "sha256"])
    assert [r.status for r in documents.integrity(recorded, actual, ["path"]).orderBy("path").collect()] == ["ok", "altered", "missing"]


PAYLOADS = {
    '{"segments": [{"start_s": 0, "end_s": 1.5, "text": " hi "}, {"start_s": 1.5, "end_s": 3, "text": "you"}]}': ("ok", "hi\nyou"),
    '{"segments": [{"start_s": 0, "text": "hi"}]}': ("ok", "hi"),
    '{"text": " all of it "}': ("ok", "all of it"),
    '{"text": "whole", "segments": [{"start_s": 0, "text": "hi"}]}': ("ok", "whole"),
    '{"text": "  ", "segments": [{"start_s": 0, "text": "hi"}]}': ("ok", "hi"),
    '{"segments": null, "text": "x"}': ("ok", "x"),
    "not json": ("not_json", None),
    "[1]": ("not_object", None),
    '{"text": " "}': ("no_text", None),
    '{"text": 5}': ("no_text", None),
    '{"segments": {}}': ("segments_not_list", None),
    '{"segments": []}': ("no_segments", None),
    '{"segments": [3]}': ("segment_not_object", None),
    '{"segments": [{"start_s": 0, "text": " "}]}': ("segment_text", None),
    '{"segments": [{"start_s": "0", "text": "a"}]}': ("start_not_a_number", None),
    '{"segments": [{"start_s": true, "text": "a"}]}': ("start_not_a_number", None),
    '{"segments": [{"text": "a"}]}': ("start_not_a_number", None),
    '{"segments": [{"start_s": -1, "text": "a"}]}': ("start_out_of_range", None),
    '{"segments": [{"start_s": 2, "end_s": 1, "text": "a"}]}': ("end_before_start", None),
    '{"segments": [{"start_s": 2, "end_s": 2, "text": "a"}]}': ("ok", "a"),
    '{"segments": [{"start_s": 2, "end_s": "3", "text": "a"}]}': ("end_not_a_number", None),
    '{"segments": [{"start_s": NaN, "text": "a"}]}': ("not_json", None),
    None: ("not_json", None),
}


def test_payloads(spark):
    df = spark.createDataFrame([(i, p, 7.0) for i, p in enumerate(PAYLOADS)], "id int, payload string, duration double")
    found = segments.validate(df, "id", "payload", "duration").orderBy("id").collect()
    assert [(r.status, r.text) for r in found] == list(PAYLOADS.values())
    assert [tuple(s) for s in found[0].segments] == [(0, 0.0, 1.5, "hi", "local_command"), (1, 1.5, 3.0, "you", "local_command")]
    assert [tuple(s) for s in found[2].segments] == [(0, 0.0, 7.0, "all of it", "local_command_text")]
    assert found[1].segments[0].end_s is None


def test_sidecars_and_summary(spark):
    media = spark.createDataFrame([("d/a.wav",), ("d/a.mp3",), ("b.wav",), ("c.wav",), ("e.wav",)], ["relative_path"])
    side = spark.createDataFrame([("d/a.transcript.txt", bytearray(b" Hello there. More \n")), ("c.transcript.txt", bytearray(b"\xff\xfe")), ("e.transcript.txt", bytearray(b"  "))], "relative_path string, content binary")
    found = segments.from_sidecars(media, side)
    assert rows(found.select("relative_path", "status", "text"), "relative_path") == [("b.wav", "missing", None), ("c.wav", "not_utf8", None), ("d/a.mp3", "ok", "Hello there. More"), ("d/a.wav", "ok", "Hello there. More"), ("e.wav", "empty", None)]
    talk = spark.createDataFrame([("t", 0, 61.0, "Hello there. More"), ("t", 1, 70.0, "and more")], "k string, id int, start_s double, text string")
    assert rows(segments.summarise(talk, "k"), "k") == [("t", 5, "[t=01:01] Hello there. (5 words)")]


def test_line_findings(spark):
    text = "fine\nkey AKIA" + "A" * 16 + " and sk-" + "b" * 20 + "\r\nghp_short\nsecret plan"
    found = scan.findings(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"), "id", "text", scan.SECRETS, ["secret plan"])
    assert rows(found, "line", "rule") == [(1, 2, "aws_key"), (1, 2, "sk_key"), (1, 4, "term: secret plan")]


def test_path_rules(spark):
    paths = ["a/NOTES.md", "x/Cache/y", "out/z", "a/b.MP3", "ok/talk.wav", "a/b.txt"]
    status = scan.path_status(F.col("p"), names=["notes.md"], folders=["cache"], prefixes=["out/"], allowed=["ok/talk.wav"])
    found = spark.createDataFrame([(p,) for p in paths], ["p"]).select("p", status.alias("s")).collect()
    assert [r.s for r in found] == ["path", "folder", "prefix", "media", None, None]


def test_bundles_are_left_out(spark):
    paths = ["lib/t/manifest.json", "lib/t/source.json", "lib/t/a.wav", "lib/t/deep/b.wav", "lib/u/manifest.json", "lib/u/c.wav", "d.wav"]
    found = scan.outside_bundles(spark.createDataFrame([(p,) for p in paths], ["relative_path"]))
    assert {r[0] for r in found.collect()} == {"lib/u/manifest.json", "lib/u/c.wav", "d.wav"}


def test_review_selection(spark):
    heads = spark.createDataFrame([("abcdef0123",), ("ffff000000",)], ["head"])
    reviews = spark.createDataFrame([("bot[bot]", "COMMENTED", "abcdef0123"), ("other", "APPROVED", "ffff000000"), ("bot", "PENDING", "ffff000000")], "author string, state string, commit_oid string")
    assert rows(scan.reviewed(heads, reviews, ["APPROVED", "COMMENTED"], "bot"), "head") == [("abcdef0123",)]
    comments = spark.createDataFrame([("bot", "No issues. Reviewed: ABCDEF0"), ("bot", "No issues. Reviewed: ffff000"), ("eve", "No issues. Reviewed: ffff000000")], "author string, body string")
    resolved = spark.createDataFrame([("abcdef0", "abcdef0123"), ("ffff000", "ffff999999")], "short string, oid string")
    assert rows(scan.commented(heads, comments, "bot[bot]", "(?i)no issues", "(?i)reviewed: ([0-9a-f]{7,40})", resolved), "head") == [("abcdef0123",)]


def test_payload_nodes(spark):
    text = json.dumps({"data": {"nodes": [{"author": {"login": "a"}, "state": "X"}, {"author": None, "state": "Y"}]}})
    found = scan.nodes(spark.createDataFrame([(text,)], ["p"]), "p", "$.data.nodes", "struct<author:struct<login:string>,state:string>")
    assert rows(found, "state") == [("a", "X"), ("", "Y")]


def test_json_schema_of_manifests():
    from tidewell import schemas

    found = schemas.json_schema(schemas.MANIFEST)
    stage = found["properties"]["stages"]["anyOf"][0]["additionalProperties"]
    assert stage["properties"]["outputs"]["anyOf"][0]["items"]["properties"]["bytes"]["anyOf"][0] == {"type": "integer"}
    assert found["properties"]["created"]["anyOf"][0] == {"type": "string", "format": "date-time"}


def test_prefix_of_any_part_of_a_path(spark):
    from tidewell.operators import scan

    rows = spark.createDataFrame([("a/Lecture-1/x.txt",), ("a/my-lecture/x.txt",), ("LECTURE.txt",), (None,)], "p string")
    found = rows.select(scan.path_status(F.col("p"), part_prefixes=["lecture"]).alias("s")).collect()
    assert [r.s for r in found] == ["part", None, "part", None]

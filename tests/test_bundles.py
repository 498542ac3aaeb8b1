import json
import os

import pytest
from pyspark.sql import functions as F

from tidewell.operators import documents
from tidewell.sources import bundles, walk


def rows(spark, n, parts=3):
    files = F.create_map(F.lit("transcript/text.md"), F.concat(F.lit("té "), "id"), F.lit("a b+c.txt"), F.lit("x"), F.lit("none"), F.lit(None))
    manifest = F.to_json(F.struct(F.lit("1.0.0").alias("schema_version"), F.concat(F.lit("b-"), "id").alias("bundle_id")))
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("b-"), "id").alias("bundle_id"), files.alias("files"), manifest.alias("manifest"))


def test_bundles_are_written_and_read(spark, tmp_path):
    root = f"file://{tmp_path}/shelf"
    bundles.write(rows(spark, 10), root)
    bundles.write(rows(spark, 12).where("bundle_id > 'b-9' or bundle_id in ('b-10', 'b-11')").where("bundle_id not in ('b-9', 'b-1')"), root)
    assert not [d for d in os.listdir(tmp_path / "shelf") if not d.startswith("batch-")]
    read = documents.read(spark, root)
    assert {r.bundle_id for r in read.collect()} == {f"b-{i}" for i in range(12)}
    found = {(r.bundle_id, r.path): r.bytes for r in bundles.files(spark, root).collect()}
    assert len(found) == 24 and found["b-3", "transcript/text.md"] == 5 and found["b-3", "a b+c.txt"] == 1
    assert sorted(map(repr, bundles.manifests(spark, root).collect())) == sorted(map(repr, read.collect()))
    assert bundles.files(spark, f"file://{tmp_path}/none").collect() == []
    one = next((tmp_path / "shelf").rglob("b-3/manifest.json"))
    assert one.read_text() == json.dumps({"schema_version": "1.0.0", "bundle_id": "b-3"}, indent=2) + "\n"


@pytest.mark.parametrize("bad", ["a/b", "", ".hidden", None])
def test_a_failing_task_leaves_nothing(spark, tmp_path, bad):
    root = f"file://{tmp_path}/shelf"
    wrong = rows(spark, 6).withColumn("bundle_id", F.when(F.col("bundle_id") == "b-5", F.lit(bad)).otherwise(F.col("bundle_id")))
    with pytest.raises(Exception):
        bundles.write(wrong, root)
    assert os.listdir(tmp_path / "shelf") == []


def test_attempts_that_lost_are_not_shown(tmp_path):
    root = f"file://{tmp_path}"
    writer = bundles.BundleWriter(root)
    for part in ("part-000000-1", "part-000000-2"):
        (tmp_path / f".writing-{writer.job}" / part / part).mkdir(parents=True)
    writer.commit([bundles.Written("part-000000-2"), None])
    assert os.listdir(tmp_path / f"batch-{writer.job}") == ["part-000000-2"]
    with pytest.raises(ValueError):
        bundles.BundleFolder({"path": root}).writer(None, True)


def put(path, data=b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_a_walk_lists_what_the_folder_source_lists(spark, tmp_path):
    from tidewell.sources import folder

    root = tmp_path / "talks"
    for name in ("a.wav", "B.WAV", "_u.mp3", ".h.ogg", "sub/c.flac", "sub/x/y/z/d.mp4", ".state/d.wav", ".tmp-run.1/e.wav", "note.txt", "done/manifest.json", "done/source.json", "done/x.wav", "done/in/x.wav", "half/manifest.json", "half/y.wav", "sub.b/k.wav", "sub/b.wav", "empty/none.txt"):
        put(root / name, name.encode())
    put(root / "a.transcript.txt", b"hello")
    put(root / "esc.wav")
    (root / "esc.transcript.txt").symlink_to(root / "a.transcript.txt")
    (root / "link.wav").symlink_to(root / "a.wav")
    (root / "loop").symlink_to(root)
    given = ([".state"], [".tmp-run."])
    want = folder.read(spark, str(root), *given).collect()
    got = walk.in_order(walk.read(spark, str(root), *given)).collect()
    assert [tuple(r) for r in got] == sorted((tuple(r) for r in want), key=lambda r: r[0].split("/")) and len(got) == 9
    (tmp_path / "nothing").mkdir()
    assert walk.read(spark, str(tmp_path / "nothing")).collect() == []


def test_folders_left_out_are_not_listed(spark, tmp_path):
    root = tmp_path / "r"
    put(root / "skip" / "a.wav")
    put(root / "keep" / "a.wav")
    os.chmod(root / "skip", 0)
    try:
        assert [r.relative_path for r in walk.walk(spark, str(root), ["skip"]).collect()] == ["keep/a.wav"]
    finally:
        os.chmod(root / "skip", 0o755)

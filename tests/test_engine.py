from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.engine import INDEXED, Engine
from tidewell.operators import contract, documents
from tidewell.sources import bundles
from tidewell.sources.folder import LISTING
from tidewell.store import StateError, Store, Transaction

DAY = datetime(2024, 1, 1)


def sidecars(spark, root):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.transcript.txt").load(str(root))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("relative_path"), "content")


def test_from_folder_to_library(spark, tmp_path):
    root = tmp_path / "talks"
    root.mkdir()
    for name in ("a.wav", "b.wav", "c.wav"):
        (root / name).write_bytes(b"same" if name != "c.wav" else b"other")
    (root / "a.transcript.txt").write_text("Hello. There.")
    (root / "b.transcript.txt").write_text("Bye.")
    engine = Engine(spark, f"file://{tmp_path}/state")
    source = engine.add_folder("talks", str(root), "review", DAY)
    assert engine.add_folder("talks", str(root), "review", DAY) == source and engine.sources().count() == 1
    with pytest.raises(StateError):
        engine.add_folder("talks", str(tmp_path), "review", DAY)
    assert sorted(r.delta for r in engine.scan("talks", DAY).collect()) == ["added"] * 3
    assert [r.delta for r in engine.scan(source, DAY + timedelta(1)).collect()] == ["unchanged"] * 3
    entries = engine.queue("discovered").collect()
    assert len(entries) == 3 and {r.attempts for r in entries} == {0}
    for r in entries:
        engine.decide(r.id, "approve", DAY + timedelta(2))
    out = engine.ingest(DAY + timedelta(3), sidecars(spark, root)).collect()
    assert sorted(r.outcome for r in out) == ["completed", "completed", "failed"]
    failed = engine.queue("failed").first()
    assert failed.last_error == "transcript missing" and failed.attempts == 1
    assert {r.bundle_id[:2] for r in engine.library().collect()} == {"a-", "b-"}
    (root / "c.transcript.txt").write_text("New.")
    engine.decide(failed.id, "retry", DAY + timedelta(4))
    engine.decide(failed.id, "approve", DAY + timedelta(4))
    assert engine.ingest(DAY + timedelta(5), sidecars(spark, root)).first().outcome == "failed"  # approved content had no sidecar
    assert [r.delta for r in engine.scan("talks", DAY + timedelta(6)).orderBy("delta").collect()] == ["changed", "unchanged", "unchanged"]
    assert engine.queue("discovered").count() == 1
    assert {r.relation: r.n for r in engine.summary().collect()}["library"] == 2


def test_unknown_names_and_versions(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/s")
    for call in (lambda: engine.scan("none", DAY), lambda: engine.decide("none", "approve", DAY), lambda: engine.add_folder("x", "/x", "odd", DAY)):
        with pytest.raises(StateError):
            call()
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "version.000000000009").write_text("999")
    with pytest.raises(StateError):
        Store(spark, f"file://{tmp_path}/t")


def test_policies(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.wav").write_bytes(b"x")
    engine = Engine(spark, f"file://{tmp_path}/s")
    engine.add_folder("off", str(root), "disabled", DAY)
    assert engine.scan("off", DAY).collect() == []
    (tmp_path / "r2").mkdir()
    (tmp_path / "r2" / "b.wav").write_bytes(b"x")
    engine.add_folder("look", str(tmp_path / "r2"), "scan-only", DAY)
    assert [r.delta for r in engine.scan("look", DAY).collect()] == ["added"] and engine.queue().count() == 0


def test_a_crash_between_queue_and_snapshot_loses_nothing(spark, tmp_path, monkeypatch):
    """Queue and snapshot move in one commit; scanning again finds the same change and queues it once."""
    media = tmp_path / "media"
    media.mkdir()
    (media / "talk.mp3").write_bytes(b"sound")
    engine = Engine(spark, f"file://{tmp_path}/state")
    engine.add_folder("talks", str(media), "review", DAY)
    replace = Transaction.replace

    def failing(t, name, rows):
        if name.startswith("items/"):
            raise OSError("crash")
        replace(t, name, rows)

    with monkeypatch.context() as m:
        m.setattr(Transaction, "replace", failing)
        with pytest.raises(OSError):
            engine.scan("talks", DAY)
    assert engine.queue().count() == 0 and engine.items().count() == 0
    assert [r.delta for r in engine.scan("talks", DAY).collect()] == ["added"]
    assert engine.queue().count() == 1 and engine.items().count() == 1


def test_one_file_from_request_to_library(spark, tmp_path):
    media = tmp_path / "talk.wav"
    media.write_bytes(b"sound")
    (tmp_path / "talk.transcript.txt").write_text("Hello. There.")
    engine = Engine(spark, f"file://{tmp_path}/state")
    first = engine.ingest_file(str(media), DAY, sidecars(spark, tmp_path)).first()
    assert first.outcome == "completed" and engine.sources().first().kind == "one-shot"
    again = engine.ingest_file(str(media), DAY + timedelta(1), sidecars(spark, tmp_path)).first()
    assert (again.id, again.bundle_id) == (first.id, first.bundle_id)
    source = engine.sources().first()
    assert engine.sources().count() == 1 and source.created_at == DAY and source.updated_at == DAY + timedelta(1)
    assert engine.queue().count() == 1 and engine.items().count() == 1 and engine.library().count() == 1
    shown = engine.show(first.bundle_id).first()
    assert shown.manifest.stages["transcribe"].outputs[0].path == "transcript.txt" and shown.manifest.stages["visual"].state == "pending"
    assert {r.status for r in engine.verify().collect()} == {"ok"} and engine.verify().count() == 2
    media.write_bytes(b"other sound")
    later = engine.ingest_file(str(media), DAY + timedelta(2), sidecars(spark, tmp_path)).first()
    assert later.id != first.id and engine.library().count() == 2
    for call in (lambda: engine.add_file(str(tmp_path / "none.wav"), DAY), lambda: engine.show("none")):
        with pytest.raises(StateError):
            call()


def test_content_that_changes_during_ingest_fails(spark, tmp_path):
    media = tmp_path / "talk.wav"
    media.write_bytes(b"sound")
    (tmp_path / "talk.transcript.txt").write_text("Hello.")
    engine = Engine(spark, f"file://{tmp_path}/state")
    kept = engine._kept

    def changing(name, rows):
        out = kept(name, rows)
        if name == "planned":
            media.write_bytes(b"new sound")
        return out

    engine._kept = changing
    assert engine.ingest_file(str(media), DAY, sidecars(spark, tmp_path)).first().outcome == "failed"
    assert engine.queue().first().last_error == "content changed during ingest" and engine.library().count() == 0


def test_a_bundle_written_but_not_indexed_is_taken_up_by_its_owner_alone(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "talk.wav").write_bytes(b"sound")
        (tmp_path / name / "talk.transcript.txt").write_text("Hello.")
    engine = Engine(spark, f"file://{tmp_path}/state")
    first = engine.ingest_file(str(tmp_path / "a" / "talk.wav"), DAY, sidecars(spark, tmp_path / "a")).first()
    engine.store.run(lambda t: t.take("library", INDEXED))  # as if it had never been indexed
    engine.decide(first.id, "retry", DAY)
    assert engine.library().count() == 0 and engine.manifests().count() == 1
    assert engine.ingest_file(str(tmp_path / "b" / "talk.wav"), DAY, sidecars(spark, tmp_path / "b")).first().outcome == "failed"
    assert engine.ingest_file(str(tmp_path / "a" / "talk.wav"), DAY, sidecars(spark, tmp_path / "a")).first().outcome == "refreshed"
    assert engine.library().count() == 1 and engine.queue("completed").count() == 1


def test_payloads_of_a_transcriber(spark, tmp_path):
    media = tmp_path / "talk.wav"
    media.write_bytes(b"sound")
    engine = Engine(spark, f"file://{tmp_path}/state")
    sides = spark.createDataFrame([], "relative_path string, content binary")
    payload = lambda text: spark.createDataFrame([("talk.wav", text)], "relative_path string, payload string")
    assert engine.ingest_file(str(media), DAY, sides, payload('{"segments": []}')).first().outcome == "failed"
    assert engine.queue().first().last_error == "transcript no_segments"
    good = '{"segments": [{"start_s": 0, "end_s": 1.5, "text": "Hello."}]}'
    assert engine.ingest_file(str(media), DAY + timedelta(1), sides, payload(good)).first().outcome == "completed"
    assert engine.queue().first().attempts == 1 and engine.queue().first().last_error is None
    other = engine.ingest_file(str(media), DAY + timedelta(2), sides, payload(good)).first()
    assert other.bundle_id == engine.library().first().bundle_id


def test_bundles_become_folders_once(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.wav").write_bytes(name.encode())
        (tmp_path / f"{name}.transcript.txt").write_text(f"Hello {name}.")
    engine, root = Engine(spark, f"file://{tmp_path}/state"), f"file://{tmp_path}/bundles"
    assert engine.write_bundles(root) == 0
    engine.ingest_file(str(tmp_path / "a.wav"), DAY, sidecars(spark, tmp_path))
    assert engine.write_bundles(root) == 1
    engine.ingest_file(str(tmp_path / "b.wav"), DAY, sidecars(spark, tmp_path))
    assert engine.write_bundles(root) == 1 and engine.write_bundles(root) == 0
    written = documents.read(spark, root)
    assert sorted(r.bundle_id for r in written.collect()) == sorted(r.bundle_id for r in engine.library().collect())
    recorded = documents.outputs(written).where("path is not null")
    assert {r.status for r in documents.integrity(recorded, bundles.files(spark, root).select("bundle_id", "path", "sha256"), ["bundle_id", "path"]).collect()} == {"ok"}
    texts = spark.read.text(f"file://{tmp_path}/bundles", recursiveFileLookup=True, pathGlobFilter="manifest.json", wholetext=True)
    assert contract.check(texts, "value", "value", schemas.manifest_contract()).collect() == []


def test_a_source_is_listed_by_the_adapter_given(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/state")
    engine.add_folder("shelf", "shelf://7", "review", DAY)
    held = [("x.wav", "a" * 64), ("y.wav", "b" * 64)]
    adapter = lambda spark, source: spark.createDataFrame([(p, f"{source.root_path}/{p}", d, 1, 1, None) for p, d in held], LISTING)
    assert [r.delta for r in engine.scan("shelf", DAY, adapter).collect()] == ["added"] * 2
    held[0] = ("x.wav", "c" * 64)
    assert sorted(r.delta for r in engine.scan("shelf", DAY, adapter).collect()) == ["changed", "unchanged"]
    for entry in engine.queue("discovered").collect():
        engine.decide(entry.id, "approve", DAY)
    sides = spark.createDataFrame([("x.transcript.txt", b"Hello."), ("y.transcript.txt", b"Bye.")], "relative_path string, content binary")
    out = engine.ingest(DAY, sides, adapter=adapter).collect()
    assert sorted(r.outcome for r in out) == ["completed", "completed", "failed"]  # the entry of the older content
    assert engine.show_entry(out[0].id).first().attempts == (out[0].outcome == "failed")
    with pytest.raises(StateError):
        engine.show_entry("none")

import wave
from pathlib import Path

from pyspark.sql import functions as F

from tidewell.functions import keys
from tidewell.sources import folder, wav
from tidewell.streaming import lifecycle


def put(path: Path, data: bytes = b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_listing_rules(spark, tmp_path):
    root = tmp_path / "talks"
    for name in ("a.wav", "B.WAV", "_u.mp3", ".h.ogg", "sub/c.flac", ".state/d.wav", ".tmp-run.1/e.wav", "note.txt", "done/manifest.json", "done/source.json", "done/x.wav", "half/manifest.json", "half/y.wav"):
        put(root / name, name.encode())
    put(root / "a.transcript.txt", b"hello")
    put(tmp_path / "far.transcript.txt", b"far")
    put(root / "esc.wav")
    (root / "esc.transcript.txt").symlink_to(tmp_path / "far.transcript.txt")
    (root / "link.wav").symlink_to(root / "a.wav")
    found = folder.read(spark, str(root), [".state"], [".tmp-run."])
    got = {r.relative_path: r for r in found.collect()}
    assert set(got) == {"a.wav", "B.WAV", "_u.mp3", ".h.ogg", "sub/c.flac", "half/y.wav"}
    assert got["a.wav"].size_bytes == 5 and got["a.wav"].sidecar_sha256 and got["B.WAV"].sidecar_sha256 is None
    items = folder.items(found, "src_1")
    want = spark.range(1).select(keys.item_id(F.lit("src_1"), F.lit("a.wav"))).first()[0]
    assert items.where("relative_path = 'a.wav'").first().id == want


def test_preflight_and_source_status(spark, tmp_path):
    put(tmp_path / "a.wav")
    row = folder.preflight(spark, str(tmp_path)).first()
    assert row.ok and row.media_files == 1
    assert not folder.preflight(spark, str(tmp_path / "none")).first().ok
    sources = spark.createDataFrame([("local-folder", "t", "/t", "review")], ["kind", "name", "root_path", "policy"])
    status = lambda *a: folder.source_status(sources, *a).first()[0]
    assert status("local-folder", "t", "/t", "review") == "existing"
    assert status("local-folder", "t", "/u", "review") == "conflict"
    assert status("local-folder", "u", "/u", "review") == "new"


def test_wav_headers(spark, tmp_path):
    for name, channels, rate, frames in (("a", 1, 16000, 4000), ("b", 2, 44100, 441)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as out:
            out.setnchannels(channels)
            out.setsampwidth(2)
            out.setframerate(rate)
            out.writeframes(b"\0\0" * channels * frames)
    put(tmp_path / "c.wav", b"RIFFbroken")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.wav"))
    found = wav.probe(files).withColumn("needs", wav.needs_normalising(F.col("wav"))).orderBy("path").collect()
    assert [(r.wav.readable, r.wav.seconds, r.needs) for r in found] == [(True, 0.25, False), (True, 0.01, True), (False, None, True)]


def test_streams(spark, tmp_path):
    schema = "id string, seq bigint, event string, error string, bundle_id string"
    rows = [("a", 1, "enqueue", None, None), ("a", 2, "fail", "bad", None), ("b", 3, "complete", None, "x"), ("a", 2, "fail", "bad", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("folded", lifecycle.fold(stream, "id"), "update"), ("once", lifecycle.enqueue_once(stream, ["id", "seq"]), "append")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
    assert {(r.id, r.state, r.attempts, r.last_error, r.bundle_id) for r in spark.table("folded").collect()} == {("a", "failed", 2, "bad", None), ("b", "completed", 0, None, "x")}
    assert spark.table("once").count() == 3

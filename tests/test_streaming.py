import random

from pyspark.sql import functions as F

from tidewell.operators import queue
from tidewell.sources import feed
from tidewell.streaming import lifecycle

EVENT = "id string, event string, error string, bundle_id string, seq bigint, at timestamp"


def events(spark, n=300, seed=5):
    rng = random.Random(seed)
    kinds = ["enqueue", "approve", "skip", "fail", "retry", "complete", "other"]
    rows = []
    for seq in range(n):
        event = rng.choice(kinds)
        rows.append((rng.choice("abcde"), event, f"e{seq}" if event == "fail" and rng.random() < 0.8 else None, f"b{seq}" if event == "complete" else None, seq))
    rows += rng.sample(rows, n // 3)  # repeated
    rng.shuffle(rows)
    return spark.createDataFrame(rows, EVENT.rsplit(",", 1)[0]).withColumn("at", F.timestamp_seconds(F.col("seq") * 60 + 1_700_000_000))


def test_late_and_repeated_events_change_nothing(spark, tmp_path):
    given = events(spark)
    given.repartition(6).write.parquet(f"{tmp_path}/in")
    want = sorted(map(repr, queue.fold(given.dropDuplicates(["id", "seq"]), "id", "seq").collect()))
    for name, time in (("plain", None), ("timed", "at")):
        out, checkpoint = f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint"
        for turn in range(2):  # the second start finds nothing new
            stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            query = lifecycle.keep_latest(lifecycle.exact_fold(stream, "id", "seq", time), out, checkpoint, availableNow=True)
            query.awaitTermination(300)
            query.stop()
        written = spark.read.parquet(out)
        assert written.select("batch").distinct().count() >= 3
        found = lifecycle.latest(written, "id")
        assert sorted(map(repr, found.select(*queue.fold(given, "id", "seq").columns).collect())) == want


def run(spark, tmp_path, root):
    stream = feed.stream(spark, str(root), f"file://{tmp_path}/listings", ("skip",))
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    query.stop()
    return sorted((r.relative_path, r.delta) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_a_feed_gives_each_change_once_over_restarts(spark, tmp_path):
    root = tmp_path / "media"
    (root / "skip").mkdir(parents=True)
    for name in ("a.wav", "b.wav", "skip/c.wav", "note.txt"):
        (root / name).write_bytes(name.encode())
    first = run(spark, tmp_path, root)
    assert first == [("a.wav", "added"), ("b.wav", "added")]
    assert run(spark, tmp_path, root) == first
    (root / "b.wav").write_bytes(b"longer now")
    (root / "d.wav").write_bytes(b"d")
    (root / "a.wav").unlink()
    want = sorted([*first, ("a.wav", "removed"), ("b.wav", "changed"), ("d.wav", "added")])
    assert run(spark, tmp_path, root) == want == run(spark, tmp_path, root)
    rows = spark.read.parquet(f"{tmp_path}/out").where("relative_path = 'b.wav'").collect()
    assert len({r.sha256 for r in rows}) == 2 and {r.size_bytes for r in rows} == {5, 10}


def test_a_batch_planned_again_has_the_same_changes(tmp_path):
    root = tmp_path / "media"
    root.mkdir()
    (root / "a.wav").write_bytes(b"a")
    options = {"path": str(root), "listings": str(tmp_path / "listings"), "filesperpartition": "1"}
    reader = feed.FeedReader(options)
    start, one = reader.initialOffset(), reader.latestOffset()
    planned = [p.rows for p in reader.partitions(start, one)]
    (root / "b.wav").write_bytes(b"b")
    again = feed.FeedReader(options)  # after a crash
    assert [p.rows for p in again.partitions(start, one)] == planned == [[("a.wav", "added")]]
    two = again.latestOffset()
    assert two != one and again.latestOffset() == two
    assert [p.rows for p in again.partitions(one, two)] == [[("b.wav", "added")]]
    again.commit(two)
    assert again.listings.numbers() == [two["listing"]] and not again.listings.add(two["listing"], {})

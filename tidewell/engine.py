"""The library's operations as set-at-a-time steps over a store."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas
from .functions import canonical, keys
from .functions import text as tx
from .operators import documents, library, queue, segments, snapshot
from .sources import bundles, folder, walk
from .store import StateError, Store, Transaction

EVENTS = schemas.flat("id string, source_id string, source_item_id string, content_sha256 string, policy string, event string, error string, bundle_id string, seq bigint, at timestamp")
BUNDLED = schemas.flat("bundle_id string, path string, content string, seq bigint, at timestamp")
INDEXED = T.StructType([*schemas.LIBRARY.fields, *schemas.flat("seq bigint").fields])
MANIFESTS = T.StructType([*schemas.MANIFEST.fields, *schemas.flat("owner string, seq bigint").fields])
_FACTS = ("source_id", "source_item_id", "content_sha256", "policy")
_AT = schemas.flat("at bigint, value string")
#: Folded events, one row for each entry.
FOLDED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("state_at", _AT), T.StructField("attempts", T.LongType()), T.StructField("error_at", _AT), T.StructField("bundle_at", _AT),
    *schemas.flat("first_seen bigint, last_seen bigint, source_id string, source_item_id string, content_sha256 string, policy string, created_at timestamp, updated_at timestamp").fields,
])
_LISTED = schemas.flat("id string, source_id string, relative_path string, absolute_path string, sha256 string, size_bytes bigint, mtime_ns bigint")
#: What a source holds: (session, source row) to rows like those of `folder.read`.
Adapter = Callable[[SparkSession, Row], DataFrame]


class Engine:
    """Sources, scans, the queue and the library.

    Every operation publishes all it changes in one commit, so several writers may work on one
    state: what one did is seen by the others or makes them start again.  Steps take their own
    time `now`.  Once `compact_after` batches of events have gathered they are folded.
    """

    def __init__(self, spark: SparkSession, root: str, compact_after: int = 64):
        self.spark, self.store, self.compact_after = spark, Store(spark, root), compact_after

    # sources

    def sources(self) -> DataFrame:
        return queue.listing(self.store.table("sources", schemas.SOURCES), "created_at", "name")

    def add_folder(self, name: str, root: str, policy: str, now) -> str:
        """The id of the source; adding the same again changes nothing, a clash raises StateError."""
        if policy not in schemas.POLICIES:
            raise StateError(f"unknown policy {policy!r}")

        def add(t: Transaction) -> str:
            old = t.table("sources", schemas.SOURCES)
            status = folder.source_status(old, "local-folder", name, root, policy).first().status
            if status == "conflict":
                raise StateError(f"a source named {name!r} or with this folder exists with other settings")
            row = self.spark.range(1).select(
                keys.source_id(F.lit("local-folder"), F.lit(root)).alias("id"), F.lit("local-folder").alias("kind"), F.lit(name).alias("name"), F.lit(root).alias("root_path"),
                F.lit(policy).alias("policy"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
            )
            if status == "new":
                t.append("sources", row)
            return row.first().id

        return self.store.run(add)

    def add_file(self, path: str, now) -> str:
        """The queue entry of a single file, approved by the request itself.

        The file becomes a source of kind `one-shot` with one item; adding it again moves only
        their times.  A completed entry stays so, any other of the same content is approved once
        more, and changed content makes a new entry.  Source, item and entry come in one commit.
        """
        if not Path(path).is_file():
            raise StateError(f"no file {path!r}")
        path, at = str(Path(path).resolve()), F.lit(now).cast("timestamp")
        name = F.concat(F.lit(f"one-shot:{Path(path).name}:"), F.right("id", F.lit(8)))
        kind = F.lit("one-shot")
        row = self.spark.range(1).select(keys.source_id(kind, F.lit(path)).alias("id")).select("id", kind.alias("kind"), name.alias("name"), F.lit(path).alias("root_path"), F.lit("review").alias("policy"), at.alias("created_at"), at.alias("updated_at"))
        source = row.first().id
        current = self._kept("found", folder.items(folder.read(self.spark, path), source))

        def add(t: Transaction) -> str:
            old = t.table("sources", schemas.SOURCES)
            since = old.where(F.col("id") == source).agg(F.min("created_at").alias("since"))
            dated = row.crossJoin(since).withColumn("created_at", F.coalesce("since", "created_at")).drop("since")  # one row each
            t.replace("sources", old.where(F.col("id") != source).unionByName(dated))
            before = t.table(f"items/{source}", schemas.ITEMS)
            merged = snapshot.merge(before, current, ["id"], at).select(*schemas.ITEMS.names)
            entry = current.select(keys.queue_id("id", "sha256").alias("id"), "source_id", F.col("id").alias("source_item_id"), F.col("sha256").alias("content_sha256"), F.lit("review").alias("policy"))
            held = self._queue(t)
            self._record(t, queue.enqueue_once(entry, held, "id"), "enqueue", now)
            self._record(t, entry.join(held.where("state = 'completed'"), "id", "left_anti").select("id"), "approve", now)
            t.replace(f"items/{source}", merged)
            return entry.first().id

        return self._committed(add)

    # scans

    def items(self) -> DataFrame:
        """Items of all sources; each source has a table of its own, so a scan rewrites no other."""
        return self.store.table("items/", schemas.ITEMS)

    def _kept(self, name: str, rows: DataFrame) -> DataFrame:
        """`rows` written once, outside of any table."""
        return self.store.read([self.store.write(name, rows)], rows.schema)

    def _found(self, t: Transaction, adapter: Adapter | None = None) -> DataFrame:
        """What the sources of approved entries hold at this moment."""
        wanted = self._queue(t).where("state = 'approved'").select(F.col("source_id").alias("id"))
        sources = t.table("sources", schemas.SOURCES).join(wanted, "id", "left_semi").collect()
        listed = [folder.items((adapter or _local)(self.spark, s), s.id) for s in sources]
        empty = self.spark.createDataFrame([], _LISTED)
        return functools.reduce(DataFrame.unionByName, listed, empty).withColumn("present", F.lit(True))

    def scan(self, source: str, now, adapter: Adapter | None = None, **rules) -> DataFrame:
        """(id, delta) of a source's items; the snapshot moves on, and what the policy allows is queued once.

        The source is listed by `adapter`, folders of the local disk by default, before the
        commit that holds the snapshot, the differences and the new entries.
        """
        mine = queue.find(self.store.table("sources", schemas.SOURCES), source).first()
        if mine is None:
            raise StateError(f"no source {source!r}")
        if mine.policy == "disabled":
            return self.spark.createDataFrame([], "id string, delta string")
        listed = adapter(self.spark, mine) if adapter else walk.read(self.spark, mine.root_path, **rules)
        current = self._kept("found", folder.items(listed, mine.id))

        def move(t: Transaction) -> DataFrame:
            previous = t.table(f"items/{mine.id}", schemas.ITEMS)
            delta = self._kept("delta", snapshot.diff(previous, current, ["id"], ["sha256", "size_bytes"]).select("id", "delta"))
            sources = self.spark.createDataFrame([(mine.id, mine.policy)], "source_id string, policy string")
            changed = delta.join(current.select("id", "source_id", F.col("sha256").alias("content_sha256")), "id")
            fresh = queue.gate(changed, sources).select(keys.queue_id("id", "content_sha256").alias("id"), "source_id", F.col("id").alias("source_item_id"), "content_sha256", "policy")
            self._record(t, queue.enqueue_once(fresh, self._queue(t), "id"), "enqueue", now)
            t.replace(f"items/{mine.id}", snapshot.merge(previous, current, ["id"], F.lit(now).cast("timestamp")).select(*schemas.ITEMS.names))
            return delta

        return self._committed(move)

    # queue

    def _committed(self, body):
        """The result of a transaction that may have added events, which are folded if many have gathered."""
        out = self.store.run(body)
        if len(self.store.head().tables.get("events", [])) >= self.compact_after:
            self.compact()
        return out

    def _record(self, t: Transaction, entries: DataFrame, event, now, error=None, bundle=None) -> None:
        """Add an event (a name or a column) for each entry, all at once."""
        empty = F.lit(None).cast("string")
        facts = [F.col(c) if c in entries.columns else empty.alias(c) for c in _FACTS]
        event = F.lit(event) if isinstance(event, str) else event
        t.append("events", entries.select("id", *facts, event.alias("event"), (empty if error is None else error).alias("error"), (empty if bundle is None else bundle).alias("bundle_id"), F.lit(t.next_seq()).cast("bigint").alias("seq"), F.lit(now).cast("timestamp").alias("at")))

    def _folded(self, base: DataFrame, events: DataFrame) -> DataFrame:
        """One row for each entry, from the folds so far and newer events."""
        facts = (*_FACTS,)
        times = events.groupBy("id").agg(F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
        newer = queue.partial(events, "id", "seq", *facts).join(times, "id").select(*FOLDED.names)
        both = base.unionByName(newer)
        held = both.groupBy("id").agg(F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
        return queue.merged(both, "id", *facts).join(held, "id").select(*FOLDED.names)

    def compact(self) -> int:
        """Fold the events that have gathered into the base that the queue is read from; how many batches they came in.

        Events that others add meanwhile stay for the next time.  The folded ones move to the
        table `history`, without being copied.  The base is sorted by entry, so that a look-up
        of one reads few of its files.
        """

        def fold(t: Transaction) -> int:
            gathered = t.paths("events")
            if gathered:
                base = self._folded(t.take("folded", FOLDED), t.take("events", EVENTS))
                t.append("folded", base.repartitionByRange("id").sortWithinPartitions("id"))
                t.keep("history", gathered)
            return len(gathered)

        return self.store.run(fold)

    def history(self) -> DataFrame:
        """All events there ever were."""
        t = Transaction(self.store)
        return t.table("history", EVENTS).unionByName(t.table("events", EVENTS))

    def _queue(self, t: Transaction) -> DataFrame:
        folded = queue.finished(self._folded(t.table("folded", FOLDED), t.table("events", EVENTS)))
        return folded.withColumn("attempts", F.col("attempts").cast("int")).select(*schemas.QUEUE.names)

    def queue(self, state: str | None = None) -> DataFrame:
        """Entries with the state their events lead to: the folded base and what came since."""
        return queue.listing(self._queue(Transaction(self.store)), "created_at", "id", **({"state": state} if state else {}))

    def show_entry(self, entry: str) -> DataFrame:
        """The queue row of one entry; no such entry raises StateError."""
        found = self._queue(Transaction(self.store)).where(F.col("id") == entry)
        if found.isEmpty():
            raise StateError(f"no entry {entry!r}")
        return found

    def decide(self, entry: str, event: str, now) -> None:
        """approve, skip or retry an entry."""

        def record(t: Transaction) -> None:
            found = self._queue(t).where(F.col("id") == entry)
            if event not in ("approve", "skip", "retry") or found.isEmpty():
                raise StateError(f"cannot {event} {entry!r}")
            self._record(t, found.select("id"), event, now)

        self._committed(record)

    def decide_all(self, entries: DataFrame, event: str, now) -> None:
        """approve, skip or retry all the entries whose `id` is given, in one commit; an unknown one raises StateError."""
        if event not in ("approve", "skip", "retry"):
            raise StateError(f"cannot {event}")
        wanted = self._kept("decided", entries.select("id").distinct())

        def record(t: Transaction) -> None:
            if not wanted.join(self._queue(t), "id", "left_anti").isEmpty():
                raise StateError(f"cannot {event} unknown entries")
            self._record(t, wanted, event, now)

        self._committed(record)

    # library

    def ingest(self, now, sidecars: DataFrame, payloads: DataFrame | None = None, entry: str | None = None, adapter: Adapter | None = None, command: Sequence[str] = ()) -> DataFrame:
        """(id, outcome, bundle_id) of all approved entries, or of one.

        Transcripts come from `payloads` (relative_path, payload: JSON of a transcriber, whose
        `command` line is part of the bundle's identity) or else from `sidecars` (relative_path, content).  An entry fails if its content changed since
        approval or while it was read, its transcript is missing or bad, or another entry owns
        the bundle, be it in the library or written without having been indexed.  The others
        complete: documents, manifest, library row and event are published in one commit, so a
        crash leaves the entry approved and nothing else.
        """
        return self._committed(lambda t: self._ingest(t, now, sidecars, payloads, entry, adapter, command))

    def _ingest(self, t: Transaction, now, sidecars: DataFrame, payloads: DataFrame | None, entry: str | None, adapter: Adapter | None, command: Sequence[str]) -> DataFrame:
        items = self._found(t, adapter)
        entries = self._queue(t)
        asked = entries if entry is None else entries.where(F.col("id") == entry)
        ready = queue.approved_unchanged(asked, items).withColumnRenamed("status", "check")
        media = ready.join(items.select(F.col("id").alias("source_item_id"), "relative_path"), "source_item_id", "left")
        read = segments.from_sidecars(media, sidecars).withColumn("identity", keys.sidecar_identity("raw_sha256"))
        if payloads is not None:
            clean = payloads.select("relative_path", F.coalesce(canonical.lenient("payload"), F.col("payload")).alias("payload"))
            said = segments.validate(clean, "relative_path", "payload").select(
                "relative_path", F.col("status").alias("said"), F.col("text").alias("said_text"), keys.command_identity(command, F.struct("text", "segments")).alias("said_identity"),
            )
            own = lambda c, other: F.when(F.col("said").isNotNull(), F.col(other)).otherwise(F.col(c))
            read = read.join(said, "relative_path", "left").withColumns({"text": own("text", "said_text"), "identity": own("identity", "said_identity"), "status": own("status", "said")})
        bundle = keys.bundle_id(tx.stem(F.regexp_extract("relative_path", r"([^/]+)$", 1)), "content_sha256", "identity")
        fault = F.when(F.col("check") != "ready", F.concat(F.lit("content "), F.col("check"))).when(F.col("status") != "ok", F.concat(F.lit("transcript "), F.col("status")))
        planned = read.select("id", *_FACTS, "relative_path", "text", fault.alias("fault"), F.when(fault.isNull(), bundle).alias("bundle_id"))
        planned = self._kept("planned", planned)
        # the media are listed once more, now that all has been read
        later = self._found(t, adapter).select(F.col("id").alias("source_item_id"), F.col("sha256").alias("later"))
        moved = ~F.col("later").eqNullSafe(F.col("content_sha256"))
        planned = planned.join(later, "source_item_id", "left").withColumn("fault", F.when(F.col("fault").isNull() & moved, "content changed during ingest").otherwise(F.col("fault"))).drop("later")
        held = self._library(t)
        owned = held.select("bundle_id", F.col("queue_item_id").alias("owner"))
        owned = owned.unionByName(library.unindexed(self._manifests(t), held).select("bundle_id", "owner"))
        claims = library.claim(planned.where("fault is null").select("id", "bundle_id"), "bundle_id", ["id"], owned)
        result = planned.join(claims.select("id", "outcome"), "id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("failed")))
        result = result.withColumn("fault", F.when(F.col("outcome") == "failed", F.coalesce("fault", F.lit("duplicate content"))))
        done = self._kept("ingested", result)
        good = done.where("outcome <> 'failed'")
        seq, at = F.lit(t.next_seq()).cast("bigint").alias("seq"), F.lit(now).cast("timestamp")
        self._write_bundles(t, good, at, seq)
        t.append("library", good.select("bundle_id", F.col("bundle_id").alias("bundle_path"), "source_id", "source_item_id", F.col("id").alias("queue_item_id"), at.alias("created_at"), seq))
        failed = F.col("outcome") == "failed"
        self._record(t, done.select("id", "outcome", "fault", F.when(~failed, F.col("bundle_id")).alias("bundle_id")), F.when(failed, "fail").otherwise("complete"), now, error=F.when(failed, F.col("fault")), bundle=F.col("bundle_id"))
        return done.select("id", "outcome", "bundle_id")

    def ingest_file(self, path: str, now, sidecars: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
        """(id, outcome, bundle_id) of one file, from its source to the library; a file that is already there is left alone."""
        entry = self.add_file(path, now)
        held = self.queue("completed").where(F.col("id") == entry)
        return self.ingest(now, sidecars, payloads, entry) if held.isEmpty() else held.select("id", F.col("state").alias("outcome"), "bundle_id")

    def _write_bundles(self, t: Transaction, good: DataFrame, at, seq) -> None:
        """Add the documents and the manifest of each bundle; the source document tells its provenance."""
        items = t.table("items/", schemas.ITEMS)
        joined = good.join(library.provenance(good.select("id", *_FACTS), t.table("sources", schemas.SOURCES), items), "id")
        joined = joined.join(items.select(F.col("id").alias("source_item_id"), "absolute_path"), "source_item_id")
        title = tx.stem(F.regexp_extract("relative_path", r"([^/]+)$", 1)).alias("title")
        source = F.to_json(F.struct(F.lit("local").alias("kind"), F.col("absolute_path").alias("ref"), title, "provenance"))
        rows = joined.select("id", "bundle_id", "absolute_path", title, source.alias("source"), "text")
        t.append("bundled", rows.select("bundle_id", F.explode(F.create_map(F.lit("source.json"), "source", F.lit("transcript.txt"), "text")).alias("path", "content"), seq, at.alias("at")))

        def stage(path: str, content: str):
            output = F.struct(F.lit(path).alias("path"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("bytes"))
            return F.struct(F.lit("done").alias("state"), at.alias("started"), at.alias("finished"), F.array(output).alias("outputs"), F.lit(None).cast("string").alias("error"))

        stages = documents.with_all_stages(F.create_map(F.lit("acquire"), stage("source.json", "source"), F.lit("transcribe"), stage("transcript.txt", "text")))
        empty = F.lit(None)
        about = F.struct(F.lit("local").alias("kind"), F.col("absolute_path").alias("ref"), "title", empty.cast("string").alias("channel"), empty.cast("timestamp").alias("published"), empty.cast("double").alias("duration_s"))
        t.append("manifests", rows.select(F.lit("1.0.0").alias("schema_version"), "bundle_id", at.alias("created"), about.alias("source"), stages.alias("stages"), F.col("id").alias("owner"), seq))

    def manifests(self) -> DataFrame:
        """The manifest of each bundle that was written, indexed or not, with its `owner`."""
        return self._manifests(Transaction(self.store))

    def _manifests(self, t: Transaction) -> DataFrame:
        return library.newest(t.table("manifests", MANIFESTS), ["bundle_id"], F.desc("seq"), F.desc("created")).drop("seq")

    def library(self) -> DataFrame:
        """A row for each bundle: when it was first indexed, and what its owner recorded last."""
        return queue.listing(self._library(Transaction(self.store)), "created_at", "bundle_id")

    def _library(self, t: Transaction) -> DataFrame:
        rows = t.table("library", INDEXED)
        others = [c for c in schemas.LIBRARY.names if c not in ("bundle_id", "created_at")]
        held = rows.groupBy("bundle_id").agg(F.max_by(F.struct(*others), "seq").alias("last"), F.min("created_at").alias("created_at"))
        return held.select("bundle_id", "last.*", "created_at").select(*schemas.LIBRARY.names)

    def show(self, bundle: str) -> DataFrame:
        """The library row of a bundle with its manifest; no such bundle raises StateError."""
        found = library.with_manifests(self.library().where(F.col("bundle_id") == bundle), self.manifests())
        if found.isEmpty():
            raise StateError(f"no bundle {bundle!r}")
        return found

    def verify(self) -> DataFrame:
        """(bundle_id, stage, state, path, sha256, bytes, status) of all outputs that manifests record: ok, altered or missing."""
        kept = library.newest(self.store.table("bundled", BUNDLED), ["bundle_id", "path"], F.desc("seq"), F.desc("at"))
        recorded = documents.outputs(self.manifests()).where("path is not null")
        return documents.integrity(recorded, kept.select("bundle_id", "path", F.sha2("content", 256).alias("sha256")), ["bundle_id", "path"])

    def write_bundles(self, root: str) -> int:
        """Write a folder below `root` for each bundle of the library that has none there yet, all at once or none; how many."""
        t = Transaction(self.store)
        wanted = self._library(t).select("bundle_id").join(bundles.manifests(self.spark, root).select("bundle_id"), "bundle_id", "left_anti")
        kept = library.newest(t.table("bundled", BUNDLED), ["bundle_id", "path"], F.desc("seq"), F.desc("at"))
        texts = kept.groupBy("bundle_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "content"))).alias("files"))
        text = F.to_json(F.struct(*schemas.MANIFEST.names), {"ignoreNullFields": "false"}).alias("manifest")
        rows = self._kept("bundles", wanted.join(texts, "bundle_id").join(self._manifests(t), "bundle_id").select("bundle_id", "files", text))
        bundles.write(rows, root)
        return rows.count()

    def summary(self) -> DataFrame:
        return library.counts(sources=self.sources(), queue=self.queue(), library=self.library())


def _local(spark: SparkSession, source: Row) -> DataFrame:
    """A folder of the local disk, walked in tasks, or a single file."""
    return walk.read(spark, source.root_path) if source.kind == "local-folder" else folder.read(spark, source.root_path)

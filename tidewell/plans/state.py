"""Queries on the parts that keep state, write files or run in rounds, over the driver's tables, with their SQL.

Each writes what it needs below the shared folder and gives whole results.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, shared
from ..engine import EVENTS, Engine
from ..functions import canonical
from ..functions import text as tx
from ..operators import chains, contract, documents, queue, scan, snapshot
from ..shipping import ship
from ..sources import bundles, feed, walk
from ..store import Conflict, Store, Transaction
from ..streaming import lifecycle
from .catalogue import _FOLD, _SNAPSHOTS, _events, _query, _t, policy_gate, snapshot_diff

# --- one commit over several tables -------------------------------------------------------


@_query("SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n, max(o_totalprice) OVER (PARTITION BY o_orderstatus) AS largest FROM orders")
def commit_log(spark, sf_dir):
    """Orders come in one commit for each status, each with the new totals; a writer that read older totals starts again."""
    store = Store(spark, shared.place(spark, "commit-log"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    totals = schemas.flat("o_orderstatus string, n bigint, largest double")
    early = Transaction(store)
    early.replace("totals", early.table("totals", totals))
    states = [r.o_orderstatus for r in orders.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]  # three

    def put(status: str):
        def body(t: Transaction) -> None:
            mine = orders.where(F.col("o_orderstatus") == status)
            t.append("orders", mine)
            t.replace("totals", t.table("totals", totals).unionByName(mine.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("largest"))))

        return body

    for status in states:
        store.run(put(status))
    try:
        early.commit()
    except Conflict:
        early.discard()
    t = Transaction(store)
    return t.table("orders", orders.schema).join(t.table("totals", totals), "o_orderstatus").select("o_orderkey", "o_orderstatus", "n", "largest")


@_query(_FOLD + "SELECT user_id, state, attempts, last_error, bundle_id FROM f")
def compacted_fold(spark, sf_dir):
    """The queue of events that came in seven batches, folded into a base after the third and the sixth."""
    engine = Engine(spark, shared.place(spark, "compacted"))
    events = _events(spark, sf_dir)
    empty = F.lit(None)
    kept = events.select(
        F.col("user_id").cast("string").alias("id"), *(empty.cast("string").alias(c) for c in ("source_id", "source_item_id", "content_sha256", "policy")),
        "event", "error", "bundle_id", F.col("event_id").alias("seq"), F.timestamp_seconds("event_id").alias("at"),
    )
    for i in range(7):
        engine.store.append("events", kept.where(F.pmod("seq", F.lit(7)) == i))
        if i in (2, 5):
            engine.compact()
    found = engine._queue(Transaction(engine.store))
    return found.select(F.col("id").cast("bigint").alias("user_id"), "state", F.col("attempts").cast("bigint").alias("attempts"), "last_error", "bundle_id")


# --- bundles, trees and streams -----------------------------------------------------------


@_query("""
SELECT 'doc-' || doc_id AS bundle_id, 'transcribe' AS stage, 'transcript/transcript.md' AS path, sha256(coalesce(text, '')) AS sha256, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, 'ok' AS status FROM documents
UNION ALL SELECT 'doc-' || doc_id, 'acquire', 'source.json', sha256('{"lang":"' || lang || '","source":"' || source || '"}'), CAST(strlen('{"lang":"' || lang || '","source":"' || source || '"}') AS BIGINT), 'ok' FROM documents
""")
def bundle_round_trip(spark, sf_dir):
    """A bundle folder for each document, written in two phases, read by its manifest and held against the files."""
    root = shared.place(spark, "bundles")
    text, source = F.coalesce("text", F.lit("")), F.to_json(F.struct("lang", "source"))
    output = lambda path, content: F.array(F.struct(F.lit(path).alias("path"), F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("bigint").alias("bytes")))
    stage = lambda outputs: F.struct(F.lit("done").alias("state"), *(F.lit(None).cast("timestamp").alias(c) for c in ("started", "finished")), outputs.alias("outputs"), F.lit(None).cast("string").alias("error"))
    stages = F.create_map(F.lit("acquire"), stage(output("source.json", source)), F.lit("transcribe"), stage(output("transcript/transcript.md", text)))
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    manifest = F.to_json(F.struct(F.lit("1.0.0").alias("schema_version"), name.alias("bundle_id"), stages.alias("stages")), {"ignoreNullFields": "false"})
    files = F.create_map(F.lit("source.json"), source, F.lit("transcript/transcript.md"), text)
    bundles.write(_t(spark, sf_dir, "documents").select(name.alias("bundle_id"), files.alias("files"), manifest.alias("manifest")), root)
    recorded = documents.outputs(bundles.manifests(spark, root)).drop("state")
    return documents.integrity(recorded, bundles.files(spark, root).select("bundle_id", "path", "sha256"), ["bundle_id", "path"])


def _address(url: Column) -> Column:
    """Path of a page's file in a tree: host, then the parts of the path."""
    return F.concat(F.regexp_extract(url, r"^[a-z]+://([^/?#]+/[^?#]*[^/?#])", 1), F.lit(".wav"))


def _planted(spark: SparkSession, paths: DataFrame) -> str:
    """A tree of files made by tasks from (path), each holding its own path."""
    root = shared.place(spark, "tree")
    top = unquote(urlparse(root).path) if "://" in root or root.startswith("file:") else root
    ship(spark)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                os.makedirs(os.path.dirname(f"{top}/{path}"), exist_ok=True)
                with open(f"{top}/{path}", "w") as out:
                    out.write(path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    os.makedirs(top, exist_ok=True)
    paths.select("path").mapInArrow(make, "n long").agg(F.sum("n")).collect()
    return top


_TREE = r"""
WITH RECURSIVE f AS (
  SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+/[^?#]*[^/?#])', 1) || '.wav' AS path FROM pages WHERE regexp_matches(url, '^[a-z]+://([^/?#]+/[^?#]*[^/?#])')
), p AS (SELECT path, string_split(path, '/') AS parts FROM f
), walk AS (
  SELECT DISTINCT 1 AS depth, parts[1] AS folder, parts[1] AS name FROM p WHERE NOT starts_with(parts[1], 'm.') AND NOT starts_with(parts[1], 'blog.')
  UNION SELECT DISTINCT w.depth + 1, w.folder || '/' || p.parts[w.depth + 1], p.parts[w.depth + 1] FROM walk w JOIN p ON len(p.parts) > w.depth + 1 AND array_to_string(p.parts[1 : w.depth], '/') = w.folder
  WHERE p.parts[w.depth + 1] <> 'fr' AND NOT starts_with(p.parts[w.depth + 1], 'm.')
)
"""


@_query(_TREE + "SELECT path AS relative_path, CAST(strlen(path) AS BIGINT) AS size_bytes, sha256(path) AS sha256 FROM p JOIN walk w ON len(parts) = w.depth + 1 AND array_to_string(parts[1 : w.depth], '/') = w.folder")
def folder_walk(spark, sf_dir):
    """A tree made of the addresses of pages, walked level by level.

    Folders named fr or with the prefix m. are skipped; hosts that begin with blog. hold both marker files and count as finished bundles.
    """
    path = _t(spark, sf_dir, "pages").select(_address(F.col("url")).alias("path")).where("path <> '.wav'").distinct()
    marks = path.where("path like 'blog.%'").select(F.explode(F.array(*(F.concat(F.substring_index("path", "/", 1), F.lit(f"/{m}")) for m in ("manifest.json", "source.json")))).alias("path"))
    root = _planted(spark, path.unionByName(marks.distinct()))
    return walk.read(spark, root, ["fr"], ["m."]).select("relative_path", "size_bytes", "sha256")


@_query(r"""
SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+/[^?#]*[^/?#])', 1) || '.wav' AS relative_path, 'added' AS delta, sha256(regexp_extract(url, '^[a-z]+://([^/?#]+/[^?#]*[^/?#])', 1) || '.wav') AS sha256
FROM pages WHERE regexp_matches(url, '^[a-z]+://([^/?#]+/[^?#]*[^/?#])')
""")
def folder_feed(spark, sf_dir):
    """The same tree as a stream: its first half, the whole after a restart, and a restart that finds nothing."""
    path = _t(spark, sf_dir, "pages").select(_address(F.col("url")).alias("path")).where("path <> '.wav'").distinct()
    path = shared.table(path, "paths")
    root, out = _planted(spark, path.where(F.pmod(F.xxhash64("path"), F.lit(2)) == 0)), shared.place(spark, "feed")
    for turn in range(3):
        if turn == 1:
            other = _planted(spark, path.where(F.pmod(F.xxhash64("path"), F.lit(2)) == 1))
            for top in sorted(os.listdir(other)):  # the second half moves in, host by host
                for at, _, names in os.walk(f"{other}/{top}"):
                    os.makedirs(f"{root}/{os.path.relpath(at, other)}", exist_ok=True)
                    for name in names:
                        os.rename(f"{at}/{name}", f"{root}/{os.path.relpath(at, other)}/{name}")
        stream = feed.stream(spark, root, f"{out}-listings").select("relative_path", "delta", "sha256")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out)


@_query(_FOLD + "SELECT * FROM f")
def streamed_fold(spark, sf_dir):
    """Events in no order, a third of them twice, through a stream of several batches."""
    events = _events(spark, sf_dir)
    copies = F.explode(F.when(F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    source, out = shared.place(spark, "stream"), shared.place(spark, "folded")
    events.select("*", copies.alias("copy")).repartition(8, F.xxhash64("event_id", "copy")).drop("copy").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(source)
    query = lifecycle.keep_latest(lifecycle.exact_fold(stream, "user_id", "event_id"), out, f"{out}-checkpoint", availableNow=True)
    query.awaitTermination()
    written = spark.read.parquet(out)
    return lifecycle.latest(written, "user_id").select(*queue.fold(events, "user_id", "event_id").columns)


# --- chains, prefixes, contracts ----------------------------------------------------------


@_query("""
WITH RECURSIVE p AS (SELECT conv_id, turn, bool_or(role = 'assistant' AND length(text) % 3 = 0) AS hit FROM conversations WHERE turn IS NOT NULL GROUP BY ALL
), walk AS (
  SELECT conv_id, turn, hit, CAST(1 AS BIGINT) AS n_read FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS top FROM p) WHERE turn = top
  UNION ALL SELECT p.conv_id, p.turn, p.hit, walk.n_read + 1 FROM walk JOIN p ON p.conv_id = walk.conv_id AND p.turn = walk.turn - 1 WHERE NOT walk.hit AND walk.turn > 0
)
SELECT conv_id, CASE WHEN hit THEN 'found' WHEN turn = 0 THEN 'exhausted' ELSE 'missing' END AS status, CASE WHEN hit OR turn = 0 THEN turn ELSE turn - 1 END AS turn, n_read
FROM walk QUALIFY n_read = max(n_read) OVER (PARTITION BY conv_id)
""")
def cursor_walk(spark, sf_dir):
    """Turns of a conversation as pages, each naming the one before; read from the last back to an answer whose length three divides."""
    pages = _t(spark, sf_dir, "conversations").where("turn is not null").select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("turn") - 1).alias("before"), "role", "text")
    starts = pages.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return chains.walk(pages, starts, "conv_id", "turn", "before", (F.col("role") == "assistant") & (F.length("text") % 3 == 0))


_OID = "substr(sha256(CAST(c_custkey % 300 AS VARCHAR)), 1, 7) || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 33)"


@_query(f"""
WITH h AS (SELECT c_custkey, {_OID} AS oid FROM customer
), s AS (SELECT DISTINCT substr(replace(CASE WHEN o_orderkey % 11 = 0 THEN 'f' || substr(oid, 2) ELSE oid END, '?', ''), 1, 7 + CAST(o_orderkey % 34 AS INTEGER)) AS short FROM orders JOIN h ON c_custkey = o_custkey)
SELECT short, CASE WHEN min(oid) = max(oid) THEN min(oid) END AS oid, CASE WHEN min(oid) IS NULL THEN 'none' WHEN min(oid) = max(oid) THEN 'one' ELSE 'ambiguous' END AS matches
FROM s LEFT JOIN h ON starts_with(oid, short) GROUP BY short
""")
def prefix_resolved(spark, sf_dir):
    """Prefixes of 7 to 40 digits, some of no hash and some of several, against the hashes of all customers."""
    digest = lambda c: F.sha2(c.cast("string"), 256)
    hashes = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.substring(digest(F.col("c_custkey") % 300), 1, 7), F.substring(digest(F.col("c_custkey")), 1, 33)).alias("oid"))
    named = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(hashes, "o_custkey")
    wrong = F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("f"), F.substring("oid", 2, 39))).otherwise(F.col("oid"))
    shorts = named.select(F.upper(F.substring(wrong, F.lit(1), (7 + F.col("o_orderkey") % 34).cast("int"))).alias("short"))
    return scan.resolved(shorts, "short", hashes, "oid")


@_query("""
SELECT o_orderkey, '$.bundle_id' AS path, 'required' AS rule FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, '$.source.kind', 'enum' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, '$.created', 'format' FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, '$.stages.acquire.outputs[1].bytes', 'type' FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, '$.stages.acquire.outputs[0].sha256', 'required' FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, '$.stages.' || o_orderpriority, 'propertyNames' FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT o_orderkey, '$.source.duration_s', 'anyOf' FROM orders WHERE o_orderkey % 13 = 0
UNION ALL SELECT o_orderkey, '$', 'json' FROM orders WHERE FALSE
""")
def manifest_violations(spark, sf_dir):
    """Manifests with faults planted by their key, checked against the contract of manifests."""
    key = F.col("o_orderkey")
    every = lambda k, wrong, right: F.when(key % k == 0, wrong).otherwise(right)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    first = F.concat(F.lit('{"path": "a", '), every(4, F.lit(""), F.lit('"sha256": "0", ')), F.lit('"bytes": 1}'))
    second = F.concat(F.lit('{"path": "b", "sha256": "1", "bytes": '), every(3, F.lit('"2"'), F.lit("2")), F.lit("}"))
    extra = every(6, F.concat(F.lit(", "), quoted(F.col("o_orderpriority")), F.lit(': {"state": "done"}')), F.lit(""))
    text = F.concat(
        F.lit("{"), every(5, F.lit(""), F.concat(F.lit('"bundle_id": '), quoted(key.cast("string")), F.lit(", "))),
        F.lit('"created": '), every(7, F.lit('"yesterday"'), quoted(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))),
        F.lit(', "source": {"ref": "r", "kind": '), F.when(F.col("o_orderstatus") == "P", F.lit('"tape"')).otherwise(F.lit('"local"')), F.lit(', "duration_s": '), every(13, F.lit("[]"), F.lit("1.5")),
        F.lit('}, "stages": {"acquire": {"state": "done", "error": null, "outputs": ['), first, F.lit(", "), second, F.lit("]}"), extra, F.lit("}}"),
    )
    return contract.check(_t(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", "text", schemas.manifest_contract())


@_query("""SELECT event_id, '{"a":' || CAST(event_id AS VARCHAR) || ',"k":' || regexp_extract(props, '([0-9]+)', 1) || ',"t":"' || event_type || '\\\\u00e9"}' AS text FROM events""".replace("\\\\u", "\\u"))
def canonical_payloads(spark, sf_dir):
    """Payloads with unordered and repeated keys, in the one form their identity is taken of."""
    made = F.concat(F.lit('{"t": "x",  "t" : "'), F.col("event_type"), F.lit('é", "k": '), F.regexp_extract("props", "([0-9]+)", 1), F.lit(', "a":'), F.col("event_id").cast("string"), F.lit("}"))
    return _t(spark, sf_dir, "events").select("event_id", canonical.canonical(made).alias("text"))


@_query()
def document_accuracy(spark, sf_dir):
    """Every document against itself without every seventh word, whatever its length."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.filter(F.split(tx.collapse("text"), " "), lambda w: w != "")
    less = F.array_join(F.filter(words, lambda w, i: i % 7 != 6), " ")
    return docs.select("doc_id", tx.word_accuracy_of_long_texts(F.col("text"), less).alias("accuracy"))


@_query(rf"""
WITH c AS (SELECT event_id, 'Said ' || event_type || '. More at ' || props AS t, greatest(0, CAST(trunc(value * 100) AS BIGINT)) AS s FROM events)
SELECT event_id, '# Summary' || chr(10) || chr(10) || '[t=' || CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END || '] ' || split_part(t, '. ', 1) || '.' ||
  chr(10) || chr(10) || 'Words: ' || len(string_split(t, ' ')) || chr(10) || chr(10) || 'Transcript method: sidecar. Summary is an extractive lead with timestamp provenance, not a faithfulness claim.' || chr(10) AS document FROM c
""")
def summary_documents(spark, sf_dir):
    said = F.concat(F.lit("Said "), F.col("event_type"), F.lit(". More at "), F.col("props"))
    return _t(spark, sf_dir, "events").select("event_id", tx.summary_document(said, F.col("value") * 100, tx.word_count(said), F.lit("sidecar")).alias("document"))


_CYCLE = r"""
WITH f AS (
  SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+/[^?#]*[^/?#])', 1) || '.wav' AS path FROM pages WHERE regexp_matches(url, '^[a-z]+://([^/?#]+/[^?#]*[^/?#])')
), d AS (
  SELECT path, regexp_replace(string_split(path, '/')[-1], '\.wav$', '') AS stem, sha256('Said in ' || path) AS side,
    sha256('media' || chr(0) || sha256(path) || chr(0) || 'transcript-sidecar' || chr(0) || sha256('Said in ' || path)) AS content, hash(path) AS h, strlen(path) % 5 = 0 AS silent FROM f
), e AS (
  SELECT path, silent, CASE WHEN silent THEN sha256('media' || chr(0) || sha256(path) || chr(0) || 'transcript-sidecar-absent') ELSE content END AS content_sha256,
    coalesce(nullif(trim(regexp_replace(lower(stem), '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'bundle') || '-' ||
    substr(sha256(content || chr(0) || sha256('{"method":"sidecar","transcript_sha256":"' || side || '"}') || chr(0)), 1, 12) AS bundle_id FROM d)
SELECT path AS relative_path, content_sha256, CASE WHEN strlen(path) % 3 = 0 THEN 'skipped' WHEN silent THEN 'failed' ELSE 'completed' END AS state,
  CAST(CASE WHEN strlen(path) % 3 <> 0 AND silent THEN 1 ELSE 0 END AS INTEGER) AS attempts,
  CASE WHEN strlen(path) % 3 <> 0 AND silent THEN 'transcript missing' END AS last_error, CASE WHEN strlen(path) % 3 <> 0 AND NOT silent THEN bundle_id END AS bundle_id,
  strlen(path) % 3 <> 0 AND NOT silent AS listed, CAST(CASE WHEN strlen(path) % 3 <> 0 AND NOT silent THEN 2 ELSE 0 END AS BIGINT) AS intact FROM e
"""


@_query(_CYCLE)
def engine_cycle(spark, sf_dir):
    """From a tree of the pages' addresses to the library: scanned, decided, ingested, listed and verified.

    Four of five files have a transcript beside them; entries of paths whose length three divides are skipped, the others approved.
    """
    path = shared.table(_t(spark, sf_dir, "pages").select(_address(F.col("url")).alias("path")).where("path <> '.wav'").distinct(), "paths")
    spoken = path.where(F.octet_length("path") % 5 != 0)
    root = _planted(spark, path)
    sides = spoken.select(tx.sidecar_name("path").alias("relative_path"), F.encode(F.concat(F.lit("Said in "), "path"), "UTF-8").alias("content"))
    _written(spark, root, sides)
    engine, now = Engine(spark, shared.place(spark, "engine")), datetime(2024, 1, 1)
    engine.add_folder("pages", root, "review", now)
    engine.scan("pages", now)
    found = engine.queue("discovered").join(engine.items().select(F.col("id").alias("source_item_id"), "relative_path"), "source_item_id")
    skipped = F.octet_length("relative_path") % 3 == 0
    engine.decide_all(found.where(skipped), "skip", now)
    engine.decide_all(found.where(~skipped), "approve", now)
    engine.ingest(now, sides)
    intact = engine.verify().where("status = 'ok'").groupBy("bundle_id").agg(F.count("*").alias("intact"))
    listed = engine.library().select(F.col("bundle_id"), F.lit(True).alias("listed")).join(intact, "bundle_id", "left")
    rows = engine.queue().join(engine.items().select(F.col("id").alias("source_item_id"), "relative_path"), "source_item_id").join(listed, "bundle_id", "left")
    none = F.lit(0).cast("bigint")
    return rows.select("relative_path", "content_sha256", "state", "attempts", "last_error", "bundle_id", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("intact", none).alias("intact"))


def _written(spark: SparkSession, root: str, texts: DataFrame) -> None:
    """Files below a local folder, written by tasks from (relative_path, content)."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open(f"{root}/{path}", "wb") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    texts.select("relative_path", "content").mapInArrow(put, "n long").agg(F.sum("n")).collect()


@_query("""
WITH j AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey AS run_id, coalesce(n, 0) AS jobs FROM orders LEFT JOIN j ON l_orderkey = o_orderkey WHERE o_custkey % 10 = 3 AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def rerun_counts(spark, sf_dir):
    """Failed jobs to run again for each failed run of a head."""
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    failed = lambda c: F.when(c == "F", "failure").otherwise("success").alias("conclusion")
    runs = o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 10).cast("string").alias("head_sha"), F.lit("completed").alias("status"), failed(F.col("o_orderstatus")), F.col("o_orderpriority").alias("event"), F.col("o_orderdate").alias("created_at"))
    jobs = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("name"), F.lit("completed").alias("status"), failed(F.col("l_linestatus")))
    return scan.reruns(runs, jobs, "3", ["1-URGENT", "2-HIGH"], "R")


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def newest_page(spark, sf_dir):
    """The newest hundred, as a page of reviews or runs is cut."""
    rows = _t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate")
    return scan.newest_page(rows, 100, F.desc("o_orderdate"), F.desc("o_orderkey"))


@_query(_SNAPSHOTS + """
SELECT 'queued' AS name, count(*) AS n FROM delta JOIN documents d USING (doc_id) WHERE delta IN ('added', 'changed') AND d.source NOT IN ('src0', 'src1')
UNION ALL SELECT k, count(delta.delta) FROM (VALUES ('added'), ('changed'), ('removed'), ('unchanged')) AS v(k) LEFT JOIN delta ON delta.delta = k GROUP BY k
""")
def scan_counts(spark, sf_dir):
    return snapshot.scan_counts(snapshot_diff(spark, sf_dir), policy_gate(spark, sf_dir))


@_query(r"""
WITH n AS (SELECT page_id, replace(url, '_', ' ') AS u FROM pages), s AS (SELECT page_id, CASE WHEN regexp_matches(u, '[^/]\.[^./]*$') THEN regexp_replace(u, '\.[^./]*$', '') ELSE u END AS u FROM n)
SELECT page_id, array_to_string(list_transform(range(1, length(u) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(u[i - 1], '[\p{Lu}\p{Ll}]') THEN lower(u[i]) ELSE upper(u[i]) END), '') AS title FROM s
""")
def titles(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tx.title("url").alias("title"))

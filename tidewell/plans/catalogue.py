"""Queries over the driver's tables, one for each operator of the survey, with their SQL.

The driver's tables stand in for registries, queues and libraries; every query reads whole
tables.  SQL is DuckDB's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions import text as tx
from ..operators import documents, library, queue, scan, segments, snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Python's white space for RE2.
_SQL_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- lookups and listings -----------------------------------------------------------------


@_query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE CAST(c_custkey AS VARCHAR) = '7' OR c_name = 'Customer#000000042'")
def id_or_name_lookup(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer")
    return queue.named(rows, 7, "Customer#000000042", "c_custkey", "c_name").select("c_custkey", "c_name", "c_nationkey")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'")
def find_one(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("id"))
    return queue.find(rows, "Customer#000000007", "id", "c_name").select("c_custkey", "c_name")


@_query("SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate, o_orderkey")
def ordered_listing(spark, sf_dir):
    return queue.listing(_t(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate", "o_orderstatus")


@_query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey")
def state_filtered_listing(spark, sf_dir):
    return queue.listing(_t(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", o_orderstatus="O").select("o_orderkey", "o_orderdate")


# --- identities ---------------------------------------------------------------------------


@_query("SELECT c_custkey, 'src_' || substr(sha256('local-folder' || chr(0) || c_name || chr(0)), 1, 16) AS stable FROM customer")
def stable_key(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", keys.source_id(F.lit("local-folder"), "c_name").alias("stable"))


@_query("""
SELECT d.doc_id, sha256('media' || chr(0) || sha256(text) || chr(0) ||
  CASE WHEN l.doc_id IS NULL THEN 'transcript-sidecar-absent' ELSE 'transcript-sidecar' || chr(0) || sha256(quality || ':' || toxic) END) AS fingerprint
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def content_fingerprint(spark, sf_dir):
    side = _t(spark, sf_dir, "labels").select("doc_id", F.sha2(F.concat_ws(":", "quality", "toxic"), 256).alias("side"))
    joined = _t(spark, sf_dir, "documents").select("doc_id", "text").join(side, "doc_id", "left")
    return joined.select("doc_id", keys.approval_digest(F.sha2("text", 256), "side").alias("fingerprint"))


@_query(r"""
SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^\p{L}\p{N}]+', '-', 'g'), '-'), ''), 'bundle') || '-' ||
  substr(sha256(sha256(html) || chr(0) || sha256('{"method":"sidecar","transcript_sha256":"' || sha256(url) || '"}') || chr(0)), 1, 12) AS bundle_id
FROM pages
""")
def planned_identity(spark, sf_dir):
    identity = keys.sidecar_identity(F.sha2("url", 256))
    return _t(spark, sf_dir, "pages").select("page_id", keys.bundle_id("url", F.sha2("html", 256), identity).alias("bundle_id"))


# --- snapshots ----------------------------------------------------------------------------


def _previous(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").where("doc_id % 7 <> 0")
    altered = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old "), F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", F.sha2(altered, 256).alias("sha256"), F.octet_length(altered).cast("bigint").alias("size_bytes"), (F.col("doc_id") % 11 != 0).alias("present"), F.lit(100).cast("bigint").alias("created_at"), F.lit(100).cast("bigint").alias("updated_at"))


def _current(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where("doc_id % 13 <> 0").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"))


_SNAPSHOTS = """
WITH prev AS (
  SELECT doc_id, sha256(t) AS sha256, CAST(strlen(t) AS BIGINT) AS size_bytes, doc_id % 11 <> 0 AS present, 100 AS created_at, 100 AS updated_at
  FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old ' || text ELSE text END AS t FROM documents WHERE doc_id % 7 <> 0)
), cur AS (SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents WHERE doc_id % 13 <> 0
), delta AS (
  SELECT coalesce(p.doc_id, c.doc_id) AS doc_id, CASE WHEN c.doc_id IS NOT NULL AND (p.doc_id IS NULL OR NOT p.present) THEN 'added'
    WHEN c.doc_id IS NOT NULL AND (c.sha256 <> p.sha256 OR c.size_bytes <> p.size_bytes) THEN 'changed'
    WHEN c.doc_id IS NOT NULL THEN 'unchanged' WHEN p.present THEN 'removed' END AS delta
  FROM prev p FULL JOIN cur c ON p.doc_id = c.doc_id)
"""


@_query(_SNAPSHOTS + "SELECT doc_id, delta FROM delta WHERE delta IS NOT NULL")
def snapshot_diff(spark, sf_dir):
    return snapshot.diff(_previous(spark, sf_dir), _current(spark, sf_dir), ["doc_id"], ["sha256", "size_bytes"])


@_query(_SNAPSHOTS + "SELECT delta, count(*) AS n FROM delta WHERE delta IS NOT NULL GROUP BY delta")
def diff_counts(spark, sf_dir):
    return snapshot.counts(snapshot_diff(spark, sf_dir))


@_query(_SNAPSHOTS + """
SELECT coalesce(p.doc_id, c.doc_id) AS doc_id, coalesce(c.sha256, p.sha256) AS sha256, coalesce(c.size_bytes, p.size_bytes) AS size_bytes, c.doc_id IS NOT NULL AS present,
  CAST(coalesce(p.created_at, 200) AS BIGINT) AS created_at, CAST(CASE WHEN c.doc_id IS NOT NULL OR p.present THEN 200 ELSE p.updated_at END AS BIGINT) AS updated_at
FROM prev p FULL JOIN cur c ON p.doc_id = c.doc_id
""")
def upsert_keep_created(spark, sf_dir):
    return snapshot.merge(_previous(spark, sf_dir), _current(spark, sf_dir), ["doc_id"], F.lit(200).cast("bigint"))


@_query(_SNAPSHOTS + "SELECT doc_id, sha256 FROM prev WHERE present AND doc_id NOT IN (SELECT doc_id FROM cur)")
def absent_rows_removed(spark, sf_dir):
    return snapshot.removed(_previous(spark, sf_dir), _current(spark, sf_dir), ["doc_id"]).select("doc_id", "sha256")


# --- queue --------------------------------------------------------------------------------


@_query("""
SELECT DISTINCT 'queue_' || substr(sha256(source || chr(0) || sha256(text) || chr(0)), 1, 16) AS queue_id FROM documents WHERE doc_id % 3 <> 0
EXCEPT SELECT 'queue_' || substr(sha256(source || chr(0) || sha256(text) || chr(0)), 1, 16) FROM documents WHERE doc_id % 3 = 0
""")
def enqueue_once(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", keys.queue_id("source", F.sha2("text", 256)).alias("queue_id"))
    return queue.enqueue_once(rows.where("doc_id % 3 <> 0"), rows.where("doc_id % 3 = 0"), "queue_id").select("queue_id")


@_query(_SNAPSHOTS + """
SELECT delta.doc_id, delta FROM delta JOIN documents d USING (doc_id)
WHERE delta IN ('added', 'changed') AND d.source NOT IN ('src0', 'src1')
""")
def policy_gate(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"))
    policy = F.when(F.col("source_id") == "src0", "disabled").when(F.col("source_id") == "src1", "scan-only").otherwise("review")
    sources = docs.select("source_id").distinct().withColumn("policy", policy)
    return queue.gate(snapshot_diff(spark, sf_dir).join(docs, "doc_id"), sources).select("doc_id", "delta")


def _events(spark, sf_dir):
    e = F.col("event_type")
    event = F.when(e == "signup", "enqueue").when(e == "view", "approve").when(e == "click", "skip").when(e == "error", "fail").otherwise("complete")
    return _t(spark, sf_dir, "events").select(
        "user_id", "event_id", event.alias("event"), F.when(e == "error", F.concat(F.lit("error "), F.col("event_id"))).alias("error"),
        F.when(e == "purchase", F.concat(F.lit("bundle-"), F.col("event_id") % 100)).alias("bundle_id"),
    )


_FOLD = """
WITH e AS (
  SELECT user_id, event_id, event_type AS t, CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'view' THEN 'approved' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'failed' ELSE 'completed' END AS state,
    CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS error, CASE WHEN event_type = 'purchase' THEN 'bundle-' || event_id % 100 END AS bundle_id FROM events
), f AS (
  SELECT user_id, max_by(state, event_id) AS state, count(*) FILTER (t = 'error') AS attempts, arg_max_null(error, event_id) FILTER (t <> 'signup') AS last_error,
    max_by(bundle_id, event_id) FILTER (bundle_id IS NOT NULL) AS bundle_id, min(event_id) AS first_seen, max(event_id) AS last_seen FROM e GROUP BY user_id)
"""


@_query(_FOLD + "SELECT * FROM f")
def lifecycle_fold(spark, sf_dir):
    return queue.fold(_events(spark, sf_dir), "user_id", "event_id")


@_query(_FOLD + "SELECT user_id, attempts, last_error FROM f WHERE state = 'failed' AND attempts >= 10")
def retry_backlog(spark, sf_dir):
    return lifecycle_fold(spark, sf_dir).where("state = 'failed' AND attempts >= 10").select("user_id", "attempts", "last_error")


@_query("""
SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'missing' WHEN d.doc_id % 4 = 0 THEN 'changed' ELSE 'ready' END AS status
FROM documents d WHERE d.doc_id % 2 = 0
""")
def approval_recheck(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 10 != 0).alias("present"))
    stated = F.when(F.col("id") % 4 == 0, F.lit("other")).otherwise(F.col("sha256"))
    entries = docs.select(F.col("id").alias("source_item_id"), F.when(F.col("id") % 2 == 0, "approved").otherwise("skipped").alias("state"), stated.alias("content_sha256"))
    return queue.approved_unchanged(entries, docs).select(F.col("source_item_id").alias("doc_id"), "status")


# --- library ------------------------------------------------------------------------------


@_query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 THEN 'completed' ELSE 'failed' END AS outcome FROM documents")
def first_owner_claim(spark, sf_dir):
    claims = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("bundle_id"))
    return library.claim(claims, "bundle_id", ["doc_id"]).select("doc_id", "outcome")


@_query("""
SELECT d.doc_id, CASE WHEN o.owner IS NULL THEN 'free' WHEN o.owner = d.doc_id THEN 'owned' ELSE 'conflict' END AS ownership
FROM documents d LEFT JOIN (SELECT md5(text) AS b, min(doc_id) AS owner FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) o ON md5(d.text) = o.b
""")
def bundle_ownership(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("bundle_id"))
    owned = docs.where("id % 2 = 0").groupBy("bundle_id").agg(F.min("id").alias("queue_item_id"))
    return library.ownership(docs, owned).select(F.col("id").alias("doc_id"), "ownership")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def idempotent_work(spark, sf_dir):
    done = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return library.pending(_t(spark, sf_dir, "orders"), done, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@_query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey, c_name, n_name FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def provenance_join(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    who = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    where = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    joined = lines.join(orders, "l_orderkey").join(who, "o_custkey").join(where, "n_nationkey")
    nested = joined.select("l_orderkey", "l_linenumber", F.struct(F.struct("l_partkey", "l_quantity").alias("item"), F.struct("o_custkey", "c_name", "n_name").alias("source")).alias("provenance"))
    return nested.select("l_orderkey", "l_linenumber", "provenance.item.*", "provenance.source.*")


@_query("SELECT 'customer' AS relation, count(*) AS n FROM customer UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'orders', count(*) FROM orders")
def relation_counts(spark, sf_dir):
    return library.counts(**{name: _t(spark, sf_dir, name) for name in ("customer", "documents", "orders")})


# --- documents ----------------------------------------------------------------------------


@_query("""
SELECT CAST(o_orderkey AS VARCHAR) AS bundle_id, l_returnflag AS stage, 'done' AS state, 'part-' || l_partkey AS path, sha256(CAST(l_partkey AS VARCHAR)) AS sha256, CAST(l_linenumber AS BIGINT) AS bytes
FROM orders JOIN (SELECT DISTINCT l_orderkey, l_returnflag, l_partkey, l_linenumber FROM lineitem) ON o_orderkey = l_orderkey
UNION ALL
SELECT CAST(o_orderkey AS VARCHAR), s, 'pending', NULL, NULL, -1 FROM orders, (VALUES ('A'), ('N'), ('R')) AS v(s)
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = s)
""")
def stage_output_explode(spark, sf_dir):
    output = F.struct(F.concat(F.lit("part-"), F.col("l_partkey")).alias("path"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"), F.col("l_linenumber").cast("bigint").alias("bytes"))
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_partkey", "l_linenumber").distinct()
    recorded = lines.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(output).alias("outputs")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("stage"), "outputs")
    stages = _t(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, "ANR"))).alias("stage")).join(recorded, ["o_orderkey", "stage"], "left")
    record = F.struct(F.when(F.col("outputs").isNull(), "pending").otherwise("done").alias("state"), F.coalesce("outputs", F.array().cast("array<struct<path:string,sha256:string,bytes:bigint>>")).alias("outputs"))
    manifests = stages.groupBy(F.col("o_orderkey").cast("string").alias("bundle_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("stage"), record.alias("record")))).alias("stages"))
    return documents.outputs(manifests).withColumn("bytes", F.coalesce("bytes", F.lit(-1).cast("bigint")))  # no null integers: frames compare them as floats


@_query("""
SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'altered' ELSE 'ok' END AS status FROM documents
""")
def integrity_check(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    recorded = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    actual = docs.where("doc_id % 17 <> 0").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return documents.integrity(recorded, actual, ["doc_id"]).select("doc_id", "status")


# --- transcripts --------------------------------------------------------------------------


@_query(rf"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '{_SQL_SPACE}+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, regexp_replace(split_part(t, '. ', 1), '\.+$', '') || '.' AS lead, CAST(CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS INTEGER) AS words FROM c
""")
def lead_summary(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", tx.lead_sentence("text").alias("lead"), tx.word_count("text").alias("words"))


@_query("""
WITH s AS (SELECT event_id, greatest(0, CAST(trunc(value * 100) AS BIGINT)) AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS anchor FROM s
""")
def time_anchor(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", tx.anchor(F.col("value") * 100).alias("anchor"))


@_query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def stitched_transcript(spark, sf_dir):
    return segments.stitch(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@_query(rf"""
WITH c AS (SELECT conv_id, turn, text, trim(regexp_replace(text, '{_SQL_SPACE}+', ' ', 'g')) AS t FROM conversations
), w AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS n FROM c
), g AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS words, arg_min(t, (turn, text)) AS t, min(turn) * 90 AS s FROM w GROUP BY conv_id)
SELECT conv_id, words, '[t=' || printf('%02d:%02d', s // 60, s % 60) || '] ' || regexp_replace(split_part(t, '. ', 1), '\.+$', '') || '. (' || words || ' words)' AS summary FROM g
""")
def conversation_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), (F.col("turn") * 90.0).alias("start_s"), "text")
    return segments.summarise(rows, "conv_id")


@_query("SELECT page_id, lower(trim(url)) LIKE 'http://%' OR lower(trim(url)) LIKE 'https://%' AS remote FROM pages")
def remote_reference_test(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", tx.is_remote("url").alias("remote"))


@_query("""
SELECT event_id, CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'not_json' WHEN json_type(props) <> 'OBJECT' THEN 'not_object'
  WHEN json_type(props, '$.k') NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE') OR json_type(props, '$.k') IS NULL THEN 'not_a_number'
  WHEN CAST(json_extract(props, '$.k') AS DOUBLE) < 0 THEN 'out_of_range' ELSE 'ok' END AS status FROM events
""")
def payload_number_status(spark, sf_dir):
    v = F.try_parse_json("props")
    status = F.when(v.isNull(), "not_json").when(segments.kind(v) != "object", "not_object").otherwise(segments.number_status(segments.field(v, "$.k")))
    return _t(spark, sf_dir, "events").select("event_id", status.alias("status"))


@_query("""
SELECT conv_id, CASE WHEN conv_id % 5 = 1 THEN 'no_segments' WHEN conv_id % 5 = 2 THEN 'start_not_a_number' WHEN conv_id % 5 = 3 THEN 'end_before_start' ELSE 'ok' END AS status,
  CASE WHEN conv_id % 5 IN (0, 4) THEN count(*) ELSE -1 END AS n FROM conversations GROUP BY conv_id
""")
def payload_validation(spark, sf_dir):
    k = F.col("conv_id") % 5
    start = F.when(k == 2, F.lit('"0"')).otherwise(F.col("turn").cast("string"))
    end = F.when(k == 3, F.lit("-0.0")).when(k == 4, F.lit("null")).otherwise((F.col("turn") + 1).cast("string"))
    end = F.when((k == 3) & (F.col("turn") > 0), F.lit("0")).when(k == 3, F.lit("1")).otherwise(end)
    one = F.concat(F.lit('{"start_s": '), start, F.lit(', "end_s": '), end, F.lit(', "text": '), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit("}"))
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", one.alias("one"))
    listed = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "one"))), lambda s: s["one"]), ", ").alias("all"))
    payload = F.concat(F.lit('{"segments": ['), F.when(F.col("conv_id") % 5 == 1, "").otherwise(F.col("all")), F.lit("]}"))
    found = segments.validate(listed.select("conv_id", payload.alias("payload")), "conv_id", "payload")
    return found.select("conv_id", "status", F.when(F.col("status") == "ok", F.size("segments")).otherwise(-1).cast("bigint").alias("n"))


@_query(rf"""
SELECT item_id, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 1 - (n // 7) / n END AS accuracy
FROM (SELECT item_id, len(list_filter(regexp_split_to_array(text, '{_SQL_SPACE}+'), lambda w: w <> '')) AS n FROM benchmark)
""")
def word_accuracy(spark, sf_dir):
    """Each benchmark text against itself without every seventh word, so a seventh of the words is the distance."""
    words = F.split(tx.collapse("text"), " ")
    less = F.array_join(F.filter(words, lambda _, i: i % 7 != 6), " ")
    return _t(spark, sf_dir, "benchmark").select("item_id", tx.word_accuracy(F.col("text"), less).alias("accuracy"))


# --- scans --------------------------------------------------------------------------------


@_query(r"""
WITH l AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS line, unnest(p) AS content FROM (
  SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1 : len(p) - 1] ELSE p END AS p FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents)
)), r AS (SELECT * FROM (VALUES
  ('github_token', 'ghp_[A-Za-z0-9_]{30,}'), ('github_fine_token', 'github_pat_[A-Za-z0-9_]+'), ('sk_key', 'sk-[A-Za-z0-9_-]{20,}'), ('aws_key', 'AKIA[0-9A-Z]{16}'),
  ('google_key', 'AIza[0-9A-Za-z_-]{35}'), ('slack_token', 'xox[baprs]-[0-9A-Za-z-]+'), ('private_key', '-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----'),
  ('assigned_token', 'token = "[0-9a-f]{40}"'), ('term: MIT License', 'MIT License')) AS v(rule, pattern))
SELECT doc_id, CAST(line AS BIGINT) AS line, rule FROM l JOIN r ON regexp_matches(content, pattern)
""")
def line_rule_findings(spark, sf_dir):
    return scan.findings(_t(spark, sf_dir, "documents"), "doc_id", "text", scan.SECRETS | scan.ASSIGNED, ["MIT License"])


@_query("SELECT page_id FROM pages WHERE regexp_matches(lower(url), '[^/]\\.html$') AND NOT regexp_matches(url, '/(en|skip[^/]*)/')")
def suffix_filter(spark, sf_dir):
    return _t(spark, sf_dir, "pages").where(scan.is_media(F.col("url"), ["en"], ["skip"], suffixes=[".html"])).select("page_id")


@_query("""
SELECT page_id, CASE WHEN lower(string_split(url, '/')[-1]) = '825' THEN 'path' WHEN list_has_any(string_split(lower(url), '/'), ['de']) THEN 'folder' WHEN starts_with(url, 'https://m.') THEN 'prefix' END AS refused FROM pages
""")
def path_rules(spark, sf_dir):
    status = scan.path_status(F.col("url"), names=["825"], folders=["DE"], prefixes=["https://m."])
    return _t(spark, sf_dir, "pages").select("page_id", status.alias("refused"))


@_query("""
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 10 = 3 ORDER BY o_orderdate DESC, o_orderkey DESC
""")
def failed_runs_newest(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    runs = o.select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 10).cast("string").alias("head_sha"), F.lit("completed").alias("status"),
        F.when(F.col("o_orderstatus") == "F", "failure").otherwise("success").alias("conclusion"), F.col("o_orderpriority").alias("event"), F.col("o_orderdate").alias("created_at"),
    )
    return scan.failed_runs(runs, "3", ["1-URGENT", "2-HIGH"]).select(F.col("run_id").alias("o_orderkey"), F.col("created_at").alias("o_orderdate"))


@_query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000)")
def exists_for_head(spark, sf_dir):
    heads = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_custkey").alias("head"))
    big = _t(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.lit("checker[bot]").alias("author"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("commit_oid"))
    return scan.reviewed(heads, big, ["P"], "checker").select("c_custkey", "c_name")


@_query("""
SELECT doc_id, 'index' AS origin FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'worktree' FROM documents WHERE doc_id % 8 = 0
UNION ALL SELECT doc_id, 'worktree' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0
""")
def candidate_union(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id")
    return scan.candidates(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 8 = 0"), docs.where("doc_id % 3 = 0"), "doc_id")


# --- operators over nested records --------------------------------------------------------


@_query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, c_mktsegment AS kind, c_name AS name, p_name AS relative_path, sha256(p_brand) AS sha256, o_orderpriority AS policy
FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % 200
""")
def provenance_record(spark, sf_dir):
    """What an entry is, where it came from and what was approved."""
    o, c, p = (_t(spark, sf_dir, n) for n in ("orders", "customer", "part"))
    entries = o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 200).alias("source_item_id"),
        F.col("o_orderpriority").alias("policy"), F.lit("").alias("content_sha256"),
    )
    sources = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("name"), F.lit("/").alias("root_path"))
    items = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("relative_path"), F.sha2("p_brand", 256).alias("sha256"))
    found = library.provenance(entries, sources, items)
    return found.select("id", "provenance.source.kind", "provenance.source.name", "provenance.item.relative_path", "provenance.item.sha256", "provenance.queue.policy")


@_query("SELECT c_custkey AS bundle_id, c_name, s_name, s_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def library_with_manifests(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bundle_id"), "c_name")
    manifests = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bundle_id"), "s_name", "s_acctbal")
    return library.with_manifests(rows, manifests).select("bundle_id", "c_name", "manifest.s_name", "manifest.s_acctbal")


@_query("SELECT o_orderkey AS bundle_id, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 4)")
def unindexed_bundles(spark, sf_dir):
    written = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bundle_id"), "o_orderstatus")
    return library.unindexed(written, _t(spark, sf_dir, "lineitem").where("l_linenumber > 4").select(F.col("l_orderkey").alias("bundle_id")))


@_query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def newest_of_each(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return library.newest(rows, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@_query("SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 2) AND lang <> 'de' AND NOT starts_with(lang, 'e')")
def media_outside_skipped(spark, sf_dir):
    ending = F.element_at(F.array(*map(F.lit, (".MP4", ".txt", ".wav", ".mov.bak"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), ending)
    return _t(spark, sf_dir, "documents").where(scan.is_media(path, ["de"], ["e"])).select("doc_id")


@_query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def failed_jobs_named(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "queued").otherwise("completed")
    jobs = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("name"), status.alias("status"), F.when(F.col("o_orderstatus") == "F", "failure").otherwise("success").alias("conclusion"))
    return scan.failed_jobs(jobs, "1-URGENT").select("o_orderkey")


@_query("""
SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR c_custkey % 2 = 0))
""")
def clean_comments(spark, sf_dir):
    """Urgent comments name a head in full, others by 12 digits that only even heads resolve."""
    oid = lambda key: F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 40)
    heads = _t(spark, sf_dir, "customer").select("c_custkey", oid("c_custkey").alias("head"))
    verdict = F.when(F.col("o_orderstatus") == "F", "clean at ").otherwise("open at ")
    named = F.when(F.col("o_orderpriority") == "1-URGENT", oid("o_custkey")).otherwise(F.substring(oid("o_custkey"), 1, 12))
    comments = _t(spark, sf_dir, "orders").select(F.lit("checker[bot]").alias("author"), F.concat(verdict, named).alias("body"))
    resolved = heads.where("c_custkey % 2 = 0").select(F.substring("head", 1, 12).alias("short"), F.col("head").alias("oid"))
    return scan.commented(heads, comments, "checker", "^clean", r"\b([0-9a-f]{12,40})\b", resolved).select("c_custkey")


@_query("""
SELECT CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'c' || o_custkey END AS author, o_orderstatus AS state, CAST(o_orderkey AS VARCHAR) AS oid FROM orders
UNION ALL SELECT 'second', 'X', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 2 = 0
""")
def payload_nodes(spark, sf_dir):
    """Nodes of JSON payloads; those of open orders have no author."""
    node = lambda login, state: F.struct(F.when(login.isNotNull(), F.struct(login.alias("login"))).alias("author"), state.alias("state"), F.col("o_orderkey").cast("string").alias("oid"))
    one = node(F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))), F.col("o_orderstatus"))
    both = F.when(F.col("o_orderkey") % 2 == 0, F.array(one, node(F.lit("second"), F.lit("X")))).otherwise(F.array(one))
    payloads = _t(spark, sf_dir, "orders").select(F.to_json(F.struct(F.struct(both.alias("nodes")).alias("data"))).alias("payload"))
    return scan.nodes(payloads, "payload", "$.data.nodes", "struct<author:struct<login:string>,state:string,oid:string>").select("author", "state", "oid")


@_query("""
SELECT p_partkey, 'source.json' AS path, sha256(p_name) AS sha256, CAST(length(p_name) AS BIGINT) AS bytes FROM part
UNION ALL SELECT p_partkey, 'other.json', p_brand, CAST(1 AS BIGINT) FROM part
""")
def output_refreshed(spark, sf_dir):
    """The digest and size of one output replaced, others left alone."""
    output = lambda path, digest: F.struct(F.lit(path).alias("path"), digest.alias("sha256"), F.lit(1).cast("bigint").alias("bytes"))
    outputs = F.array(output("source.json", F.lit("old")), output("other.json", F.col("p_brand")))
    changed = documents.with_output(outputs, "source.json", F.sha2("p_name", 256), F.length("p_name").cast("bigint"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.explode(changed).alias("output")).select("p_partkey", "output.*")


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN coalesce(event_type, 'not_recorded') ELSE 'not_recorded' END AS posture FROM events")
def recorded_posture(spark, sf_dir):
    said = F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
    document = F.struct(F.struct(F.struct(said.alias("posture")).alias("remote_services")).alias("transcript"))
    return _t(spark, sf_dir, "events").select("event_id", documents.posture(document).alias("posture"))


@_query(rf"""
WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^{_SQL_SPACE}+', ''), '{_SQL_SPACE}+$', '') AS said FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN said = '' THEN 'empty' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 3 <> 0 AND said <> '' THEN sha256(said) END AS said FROM s
""")
def sidecar_texts(spark, sf_dir):
    """Two of three documents have their text in a sidecar."""
    docs = _t(spark, sf_dir, "documents")
    media = docs.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".wav")).alias("relative_path"))
    sides = docs.where("doc_id % 3 <> 0").select(F.concat(F.col("doc_id").cast("string"), F.lit(tx.SIDECAR_SUFFIX)).alias("relative_path"), F.encode("text", "UTF-8").alias("content"))
    return segments.from_sidecars(media, sides).select("doc_id", "status", F.sha2("text", 256).alias("said"))

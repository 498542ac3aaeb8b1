"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, divergence, html, infill, language, licenses, lines, minhash, mixing, quality, tokens, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: `lang` is the declared language, the source stands for the host."""
    docs = _read(spark, sf_dir, "documents")
    model = language.fit(docs, "text", "lang")
    found = language.identify(docs, model, "doc_id", "text", declared=F.col("lang"), host=F.col("source"))
    return found.withColumnRenamed("id", "doc_id")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: text of the article, language of the markup, host and suffix of the address.

    Every page gives a row, also those with a null or repeated id; one without html has no text and is not kept.
    """
    pages = html.main_text(_read(spark, sf_dir, "pages"), "page_id", "url", "html")
    model = language.fit(_read(spark, sf_dir, "documents"), "text", "lang")
    host = F.lower(F.regexp_extract("url", r"^(?:.*?://)?(?:[^/?#]*@)?([^/?#:@]*)", 1))
    found = language.identify(pages, model, "id", "text", F.col("declared"), host, F.regexp_extract(host, r"([^.]*)$", 1))
    return found.withColumnRenamed("id", "page_id")


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.preferences(_read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    masks = {f"{s}_mask": chat.spans_text(F.col(f"{s}_mask")) for s in ("chosen", "rejected")}
    return found.withColumnRenamed("conv", "conv_id").withColumns(masks)


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return minhash.components_by_hyperminhash(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`removed` as text, positions by comma."""
    found = lines.dedup_lines(_read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
    return found.withColumn("removed", F.array_join("removed", ","))


def op2_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(_read(spark, sf_dir, "pages"), "page_id", "url", "html")
    return found.select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"), "page_id", "url", "html")


def op4_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    return decontam.digest(decontam.contamination(docs, benchmark, "doc_id", "text", "item_id", "text")).withColumnRenamed("id", "doc_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = tokens.token_counts(_read(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumnRenamed("id", "doc_id").withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_min_cost_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(_read(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op11_tiled_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"), "text", "lang", "source")


def op12_rank_select_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.infill(_read(spark, sf_dir, "documents"), "doc_id", "text")
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(infill.restored(F.col("output"), F.col("form")), 256)}
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *(v.alias(k) for k, v in digests.items()))


def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents"), "doc_id", "text")
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined).select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_template_text": op2_template_text,
    "op3_warc_normaliser": op3_warc_normaliser,
    "op4_rule_cascade": op4_rule_cascade,
    "op5_wu_manber": op5_wu_manber,
    "op6_language_id": op6_language_id,
    "language_id_pages": language_id_pages,
    "op7_preference_pairs": op7_preference_pairs,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_token_counts": op9_token_counts,
    "op10_min_cost_mix": op10_min_cost_mix,
    "op11_tiled_divergence": op11_tiled_divergence,
    "op12_rank_select_infill": op12_rank_select_infill,
    "op13_license_diagonals": op13_license_diagonals,
}


def _sql_list(values: list, quote: str = "'") -> str:
    return "[" + ", ".join(f"{quote}{v}{quote}" for v in values) + "]"


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEMPLATES = ", ".join(f"({i}, '{t.label}', {_sql_list(t.words())}, CAST({_sql_list(t.needed(), '')} AS BIGINT[]))" for i, t in enumerate(licenses.TEMPLATES))
ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
WITH RECURSIVE split AS MATERIALIZED (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), met AS MATERIALIZED (
  SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(list_transform(ls, lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS line FROM split) WHERE line <> ''
), lines AS MATERIALIZED (SELECT row_number() OVER (ORDER BY line) AS id, line FROM (SELECT DISTINCT line FROM met)
), s AS MATERIALIZED (
  SELECT DISTINCT id, substring(line, i, 8) AS g FROM (SELECT id, line, unnest(range(1, greatest(length(line) - 7, 1) + 1)) AS i FROM lines)
), n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id
), f AS (SELECT g, count(*) AS f FROM s GROUP BY g
), ranked AS (SELECT id, g, n, row_number() OVER (PARTITION BY id ORDER BY f, g) AS k FROM s JOIN f USING (g) JOIN n USING (id)
), prefix AS MATERIALIZED (SELECT id, g, n FROM ranked WHERE k <= n - (4 * n + 4) // 5 + 1
), near AS MATERIALIZED (
  SELECT DISTINCT x.id AS a, y.id AS b, x.n AS na, y.n AS nb FROM prefix x JOIN prefix y ON x.g = y.g AND x.id < y.id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
), links AS (
  SELECT a, b FROM near JOIN s x ON x.id = a JOIN s y ON y.id = b AND y.g = x.g GROUP BY a, b, na, nb HAVING 180 * count(*) >= 80 * (na + nb)
), undirected AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (SELECT DISTINCT a AS id, a AS root FROM undirected UNION SELECT undirected.b, reach.root FROM reach JOIN undirected ON reach.id = undirected.a
), comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id
), placed AS (SELECT doc_id, pos, coalesce(c, id) AS c FROM met JOIN lines USING (line) LEFT JOIN comp USING (id)
), gone AS (
  SELECT doc_id, count(*) AS n_lines, coalesce(list(pos ORDER BY pos) FILTER (k > 1), []) AS removed
  FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY c ORDER BY doc_id, pos) AS k FROM placed) GROUP BY doc_id
)
SELECT doc_id, CASE WHEN len(removed) > 0 THEN coalesce(array_to_string(list_filter(ls, lambda l, i: NOT list_contains(removed, i - 1)), chr(10)), '') ELSE text END AS text,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_lines - len(removed), 0) AS BIGINT) AS n_kept, coalesce(array_to_string(removed, ','), '') AS removed
FROM split LEFT JOIN gone USING (doc_id)
""",
    "op3_warc_normaliser": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
), r AS (SELECT *, payload_bytes >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top AS again FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM r
""",
    "op4_rule_cascade": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w) WHERE c > 1
), r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id
), b AS (
  SELECT d.doc_id, text, ws, ls, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
  OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
  OR (n_dup_lines >= 3 AND 2 * n_dup_lines > len(ls))
  OR 5 * len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1])) > n_words
  OR (length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g'))) / length(text) > 0.4
  OR (length(text) - length(regexp_replace(text, '\p{L}+', '', 'g'))) / length(text) < 0.5
  OR length(regexp_replace(text, '[^!?]+', '', 'g')) * 5 > n_words
  OR len(list_filter(ls, lambda l: regexp_matches(l, '^[ \t]*[-*•·] '))) / len(ls) > 0.9
  OR len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)\s*$'))) / len(ls) > 0.3
  OR NOT list_has_any(list_transform(ws, lambda x: lower(x)), [""" + ", ".join(f"'{w}'" for w in quality.COMMON) + r"""])) AS kept
FROM f
""",
    "op5_wu_manber": r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, l, array_to_string(ws[i : i + l - 1], ' ') AS g
  FROM (SELECT item_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM (SELECT *, least(13, len(ws)) AS l FROM b WHERE len(ws) > 0))
), dw AS (
  SELECT doc_id, l, i, array_to_string(ws[i : i + l - 1], ' ') AS g
  FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l)
), m AS (SELECT doc_id, item_id, dw.l, i FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, l, i FROM m)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ks, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op7_preference_pairs": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), o AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role, text) AS ts FROM t GROUP BY conv_id
), a AS (SELECT *, list_filter(range(1, len(ts) + 1), lambda i: ts[i].r = 'assistant') AS answers FROM o
), e AS (SELECT *, ts[1 : answers[-1]] AS chosen, answers[1 + ((coalesce(conv_id, 0) % len(answers)) + len(answers)) % len(answers)] AS k FROM a WHERE len(answers) > 0
), f AS (SELECT ts[1] AS opening, min(conv_id) AS lead FROM o GROUP BY 1 HAVING count(*) > 1
), given AS (
  SELECT conv_id, 'echo' AS kind, NULL AS other, chosen,
    list_transform(chosen, lambda s, i: CASE WHEN i = k THEN struct_pack(r := 'assistant', x := CASE WHEN i > 1 THEN chosen[i - 1].x ELSE '' END) ELSE s END) AS rejected FROM e
  UNION ALL SELECT o.conv_id, 'sibling', lead, p.ts, o.ts FROM o JOIN f ON o.ts[1] = f.opening JOIN o p ON p.conv_id = f.lead WHERE o.conv_id IS DISTINCT FROM lead
), n AS (
  SELECT *, coalesce(nullif(list_position(list_transform(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] = rejected[i]), false), 0) - 1, least(len(chosen), len(rejected))) AS c FROM given
), pairs AS (SELECT conv_id, kind, other, c, chosen[1 : c] AS p, chosen[c + 1 :] AS a, rejected[c + 1 :] AS b FROM n WHERE c < greatest(len(chosen), len(rejected))
), every AS (
  SELECT * FROM pairs UNION ALL SELECT conv_id, 'none', NULL, len(ts), ts, ts[1 : 0], ts[1 : 0] FROM o WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE kind = 'echo' AND pairs.conv_id IS NOT DISTINCT FROM o.conv_id)
)
SELECT conv_id, kind, CAST(other AS BIGINT) AS other, CAST(c AS INTEGER) AS n_common, """ + ", ".join(
        f"coalesce(array_to_string(list_transform({x}, lambda s: '<|' || s.r || '|>' || chr(10) || s.x || '<|end|>' || chr(10)), ''), '') AS {name}" for x, name in (("p", "prompt"), ("a", "chosen_text"), ("b", "rejected_text"))
    ) + ", " + ", ".join(
        f"coalesce(array_to_string(list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN {x}[i].r = 'assistant' THEN CAST(5 + length({x}[i].r) + coalesce(list_sum(list_transform({x}[1 : i - 1], lambda s: 13 + length(s.r) + length(s.x))), 0) AS BIGINT) || '-' || CAST(13 + length({x}[i].r) + length({x}[i].x) + coalesce(list_sum(list_transform({x}[1 : i - 1], lambda s: 13 + length(s.r) + length(s.x))), 0) AS BIGINT) END), lambda s: s IS NOT NULL), ','), '') AS {name}"
        for x, name in (("a", "chosen_mask"), ("b", "rejected_mask"))
    ) + """ FROM every
""",
    "op8_hyperminhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sig AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id
), rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS r FROM sig
), rs AS (SELECT s.* FROM s WHERE doc_id IN (SELECT r FROM rep)
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM rs x JOIN rs y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), undirected AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (SELECT DISTINCT r AS id, r AS root FROM rep UNION SELECT undirected.b, reach.root FROM reach JOIN undirected ON reach.id = undirected.a
), comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN comp ON comp.id = rep.r
""",
    "op11_tiled_divergence": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), e AS (SELECT doc_id, lang, source, unnest(ws) AS term FROM d
), v AS (SELECT lang, term, count(*) AS total FROM e GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3
), z AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM v GROUP BY lang
), c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN v USING (lang, term) GROUP BY ALL
), g AS (
  SELECT g.lang, g.source, coalesce(z.v, 0)::HUGEINT AS v, coalesce(z.n_lang, 0)::HUGEINT AS n_lang, coalesce(n.n, 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN z USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) n USING (lang, source)
), p AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p, 1 + 1000000000::HUGEINT * (v.total + 1) // (g.n_lang + g.v) AS q
  FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 200
""",
    "op12_rank_select_infill": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (SELECT *, len(u) AS n, [CAST('0x' || substr(s, 1 + 8 * i, 8) AS BIGINT) for i in range(4)] AS h FROM d
), c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), x AS (SELECT *, coalesce(array_to_string(u[1 : lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1 : hi], ''), '') AS m, coalesce(array_to_string(u[hi + 1 :], ''), '') AS r FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || r || '<M>' || m ELSE '<S>' || r || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
""",
    "op13_license_diagonals": rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT doc_id, len(ws) AS n_words, list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'cc' AND ws[i + 1] = 'by') AS cc,
    list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license') AS gpl,
    list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved') AS res FROM d
), t(template, label, ts, needs) AS (VALUES {_TEMPLATES}
), tg AS (SELECT template, len(ts) AS n, place, array_to_string(ts[place + 1 : place + 3], ' ') AS g FROM (SELECT *, unnest(range(len(ts) - 2)) AS place FROM t)
), dg AS (SELECT doc_id, a, array_to_string(ws[a + 1 : a + 3], ' ') AS g FROM (SELECT *, unnest(range(len(ws) - 2)) AS a FROM d)
), met AS MATERIALIZED (SELECT doc_id, template, n, a, place, a - place AS diagonal FROM dg JOIN tg USING (g)
), steps AS (SELECT *, (diagonal - lag(diagonal) OVER w) * 5 > n AS far FROM (SELECT DISTINCT doc_id, template, n, diagonal FROM met) WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)
), islands AS (SELECT doc_id, template, diagonal, sum(CASE WHEN coalesce(far, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM steps
), spans AS (
  SELECT doc_id, template, n, min(a) AS first, max(a) + 3 AS stop, list_distinct(flatten(list([place, place + 1, place + 2]))) AS covered
  FROM met JOIN islands USING (doc_id, template, diagonal) GROUP BY doc_id, template, n, island
), held AS (
  SELECT doc_id, list(DISTINCT label) AS ls, max(len(covered) / n) AS score FROM spans JOIN t USING (template)
  WHERE 100 * len(covered) >= 85 * n AND list_has_all(covered, needs) AND 2 * (stop - first) <= 3 * n GROUP BY doc_id
), own AS (
  SELECT *, list_concat(cc, gpl, res) AS places, list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END], lambda l: l IS NOT NULL) AS base FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(ls, [])))), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM own LEFT JOIN held USING (doc_id)
""",
}

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import quality, queries


def repeated(words, window=8):
    at = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    return len({j for i in range(len(words) - window + 1) if at[tuple(words[i : i + window])] > 1 for j in range(i, i + window)})


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, again = len(words), repeated(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), again, n < 20 or 100 * again > 30 * n


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c d", "\n", "#x", "é\n"]), max_size=60), min_size=8, max_size=20))
def test_base_counts(spark, lists):
    texts = [" ".join(x) for x in lists] + [" ".join("abcdefgh" * 3), " ".join("abcdefghi" * 2), None, "", " \n "]
    found = quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id", "text").collect()
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_order_of_rules_does_not_change_the_verdict(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    given = quality.rules()
    one = {r.id: r.kept for r in quality.quality(docs, "doc_id", "text", given).collect()}
    two = {r.id: r.kept for r in quality.quality(docs, "doc_id", "text", given[::-1], sample_rows=0).collect()}
    assert one == two and set(one.values()) == {True, False}


def test_rules_are_ordered_by_rejections_per_cost(spark):
    sample = quality.base_counts(spark.createDataFrame([("x " * 30,)] * 50, "text string")).cache()
    never, always = quality.Rule("never", F.lit(False)), quality.Rule("always", F.col("n_words") > 0)
    assert [r.name for r in quality.order_rules(sample, [never, always])] == ["always", "never"]


def test_junk_is_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    found = docs.join(quality.quality(docs, "doc_id", "text").withColumnRenamed("id", "doc_id"), "doc_id").where("n_words >= 20")
    rows = found.select("quality", "kept").collect()
    assert sum(r.kept for r in rows if r.quality) >= 0.98 * sum(r.quality for r in rows)
    assert sum(r.kept for r in rows if not r.quality) <= 0.2 * sum(not r.quality for r in rows)


def test_no_python_on_executors(spark, awkward):
    found = quality.quality(awkward, "doc_id", "text")
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert len(found.collect()) == awkward.count()
    assert quality.quality(awkward.limit(0), "doc_id", "text").collect() == []


def test_equals_sql(agree):
    agree(queries.QUERIES["op4_rule_cascade"], queries.ORACLES["op4_rule_cascade"])

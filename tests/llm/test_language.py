import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.llm import language, queries
from tidewell.llm.hashing import strings


def test_held_out_accuracy(spark, sf):
    """Fitted on even ids, tested by text alone on odd ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"), "text", "lang")
    found = language.identify(docs.where("doc_id % 2 = 1"), model, "doc_id", "text").join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("truth"), "n_chars"), "id")
    rows = found.where("n_chars > 40").collect()
    assert np.mean([r.lang == r.truth for r in rows]) > 0.98
    assert np.mean([r.kept for r in rows]) > 0.99


def test_evidence_decides_where_the_text_does_not(spark):
    """Short texts lean on the declared language, and on the host where nothing is declared."""
    en, de = "the water and the house of the people ", "das wasser und die haus der leute ein "
    rows = [(i, (en if i % 2 else de) * 4, "en" if i % 2 else "de", "hosta" if i % 2 else "hostb") for i in range(200)]
    rows += [(900, "o", None, "hosta"), (901, "o", None, "hostb"), (902, "o", "de-AT", "hostc"), (903, "o", "en", "hostc")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, host string")
    model = language.fit(df.where("doc_id < 200"), "text", "lang")
    got = {r.id: r.lang for r in language.identify(df, model, "doc_id", "text", F.col("lang"), F.col("host")).collect()}
    assert got[900] == "en" and got[901] == "de" and got[902] == "de" and got[903] == "en"


def test_unknown_and_awkward_rows(spark, awkward, sf):
    model = language.fit(spark.read.parquet(f"{sf}/documents.parquet"), "text", "lang")
    found = language.identify(awkward, model, "doc_id", "text", F.col("lang"), F.col("source")).collect()
    assert len(found) == awkward.count()
    assert not any(r.kept for r in found if r.id in (2, 3, 4))
    odd = spark.createDataFrame([(1, "жшщ фыв цук " * 30), (2, "12345 !!! ---")], "doc_id int, text string")
    assert [(r.lang == "und" or r.n_grams == 0, r.kept) for r in language.identify(odd, model, "doc_id", "text").orderBy("id").collect()] == [(True, False)] * 2
    assert language.identify(awkward.limit(0), model, "doc_id", "text").collect() == []
    none = language.fit(awkward.limit(0), "text", "lang")
    assert {r.kept for r in language.identify(awkward, none, "doc_id", "text").collect()} == {False}


def test_own_counts_are_left_out_of_the_host(spark, sf):
    """Host priors come from other rows: a host's only document gets none from itself."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs, "text", "lang")
    alone = docs.withColumn("host", F.col("doc_id").cast("string"))
    one = {r.id: round(r.confidence, 6) for r in language.identify(alone, model, "doc_id", "text", host=F.col("host")).collect()}
    assert len(one) == docs.count() and all(0 <= c <= 1 for c in one.values())


def test_trigrams_stay_in_their_rows():
    import pyarrow as pa

    together, first = language.trigrams(*strings(pa.array(["ab", "", "cd?", "É"])))
    apart = [language.trigrams(*strings(pa.array([t])))[0].tolist() for t in ("ab", "", "cd?", "É")]
    assert [together[a:b].tolist() for a, b in zip(first, first[1:])] == apart


def test_pages_query(spark, sf):
    found = queries.QUERIES["language_id_pages"](spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/pages.parquet").count() and np.mean([r.kept for r in found]) > 0.95


def test_copies_of_a_text_count_once_in_the_sample(spark):
    """100,000 copies of one text teach no more than one; the sample is of different texts."""
    texts = [f"the water number {i} of the {['house', 'river', 'people', 'valley'][i % 4]} and the {i % 13} others" for i in range(500)]
    plain = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("lang", F.lit("en"))
    copies = spark.range(100_000).select(F.lit(texts[0]).alias("text"), F.lit("en").alias("lang"))
    one, two = (language.fit(rows, "text", "lang", per_language=100) for rows in (plain, plain.unionByName(copies)))
    assert one.languages == two.languages and np.array_equal(one.table, two.table)
    assert (two.table > two.table.min()).sum() > len(np.unique(language.trigrams(*strings(pa.array([texts[0]])))[0]))


def test_posterior_is_the_product_of_its_evidence(spark):
    """Every number of a small table by hand: likelihood, declared language, and priors of host, suffix and all."""
    rng = np.random.default_rng(4)
    vocabulary = {"en": ["the", "water", "house", "people"], "de": ["das", "wasser", "haus", "leute"], "fr": ["eau", "maison", "gens", "du"]}
    rows = []
    for i in range(60):
        lang = ["en", "de", "fr"][int(rng.integers(3))]
        said = " ".join(rng.choice(vocabulary[lang], int(rng.integers(0, 6))))
        rows.append((i, said, [lang, "en", None, "xx"][int(rng.integers(4))], f"h{int(rng.integers(5))}", ["com", "de"][int(rng.integers(2))]))
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, host string, tld string")
    model = language.fit(spark.createDataFrame([(" ".join(v), k) for k, v in vocabulary.items()], "text string, label string"), "text", "label")
    found = {r.id: r for r in language.identify(df, model, "doc_id", "text", F.col("lang"), F.col("host"), F.col("tld")).collect()}
    k, strength = 4, 10.0
    declared = ["none" if d is None else d if d in vocabulary else "other" for _, _, d, _, _ in rows]
    grams = [language.trigrams(*strings(pa.array([t])))[0] for _, t, *_ in rows]
    normal = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    ll = np.array([np.append(model.table[:, g].sum(1), language.UNKNOWN * len(g)) * min(len(g), language.ENOUGH) / max(len(g), 1) / language.OVERLAP for g in grams])
    own = np.array([normal(x) if len(g) else np.zeros(k) for x, g in zip(ll, grams)])
    kinds = [*model.languages, "other", "none"]
    seen = np.zeros((k, len(kinds)))
    for x, d, g in zip(own, declared, grams):
        if len(g):
            seen[x.argmax(), kinds.index(d)] += 1
    trust = np.log((seen + 1) / (seen.sum(1, keepdims=True) + len(kinds)))
    overall = (own.sum(0) + 1) / (own.sum(0) + 1).sum()
    for i, (doc, _, _, host, tld) in enumerate(rows):
        shrink = lambda held, parent: (np.maximum(held - own[i], 0) + strength * parent) / (np.maximum(held - own[i], 0).sum() + strength)
        parent = shrink(sum(own[j] for j, r in enumerate(rows) if r[4] == tld), overall)
        prior = shrink(sum(own[j] for j, r in enumerate(rows) if (r[3], r[4]) == (host, tld)), parent)
        posterior = normal(ll[i] + trust[:, kinds.index(declared[i])] + np.log(prior))
        assert abs(found[doc].confidence - posterior.max()) < 1e-6
        assert found[doc].lang == [*model.languages, "und"][posterior.argmax()] and found[doc].n_grams == len(grams[i])

import corpus_pipeline
from tidewell.llm import common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def run(spark, docs, sf):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.table(stage(spark, docs, sf), name)
        out.append(docs)
    return out


def test_stages_over_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = run(spark, docs, sf)
    assert all(s.columns == COLUMNS for s in stages[:-1])
    counts = [docs.count(), *(s.count() for s in stages)]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    texts = [r.text for r in stages[1].collect()]
    lines = [x.strip() for t in texts for x in t.split("\n") if x.strip()]
    assert len(lines) == len(set(lines))
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, stages[-1].collect()))
    assert all(r.taken == r.copies * r.size > 0 for r in whole.collect())


def test_planted_cases(spark, sf, documents):
    """Copies, near copies, contaminated and foreign texts go; clean ones stay."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    clean = [r for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars between 600 and 3000").orderBy("doc_id").collect()]
    base = " ".join(f"{w}" for w in clean[0].text.replace("\n", " ").split())
    near = base.split(" ")
    near[40] = "replaced"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, item), (5, "12 34 56 78 " * 20), (6, " ".join(reversed(base.split(" "))))]
    got = run(spark, documents(*rows), sf)
    ids = [sorted(r.doc_id for r in s.collect()) for s in got]
    assert ids[0] == [1, 2, 3, 4, 6]  # 5 has no letters
    assert ids[2] == [1, 4, 6] and ids[3] == [1, 6]
    assert set(ids[4]) <= {1, 6}


def test_awkward_rows(spark, sf, awkward):
    stages = run(spark, awkward, sf)
    assert all(s.columns[: len(awkward.columns)] == awkward.columns for s in stages[:-1])
    empty = run(spark, awkward.limit(0), sf)
    assert [s.count() for s in empty] == [0] * 5


def test_null_ids_pass_every_stage(spark, sf, documents):
    text = "the people of the house and the water of the river are in the valley for this is their home"
    stages = run(spark, documents((None, text), (None, text.replace("valley", "city") + " and they stay there with all of them")), sf)
    assert all(s.count() for s in stages)


def test_two_runs_at_once_keep_their_own_tables(spark, sf, documents):
    """Each stage is called twice before either result is read; a third run of the last stage harms none."""
    text = "the people of the house and the water of the river are in the valley for this is their home"
    docs = documents(*((i, f"{text} number {'abcdefgh'[i]} of them and {'xyzuvwst'[i]}", "en", f"s{i % 2}") for i in range(8)))
    one = two = docs
    for name, stage in corpus_pipeline.STAGES:
        later, sooner = stage(spark, one, sf), stage(spark, two, sf)
        one, two = common.table(later, name), common.table(sooner, name)
    last = corpus_pipeline.STAGES[-1][1]
    again = [last(spark, docs, sf) for _ in range(3)]
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())) and one.count()
    assert len({repr(sorted(map(repr, a.collect()))) for a in again}) == 1


def test_a_stage_removes_what_made_its_documents_once_they_are_written(spark, sf, documents):
    text = "the people of the house and the water of the river are in the valley for this is their home"
    first, second = (f for _, f in corpus_pipeline.STAGES[:2])
    made = first(spark, documents((1, text), (2, text)), sf)
    mark = made.schema["doc_id"].metadata[corpus_pipeline._MARK]
    second(spark, made, sf).count()  # not written: its tables are still read
    assert mark in corpus_pipeline._left and made.count() == 2
    second(spark, common.table(made, "written"), sf).count()
    assert mark not in corpus_pipeline._left

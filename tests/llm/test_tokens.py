import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import tokens
from tidewell.llm.hashing import strings

PATH = public_tokenizers.path("byte_bpe_50k.json")
LENGTHS = tokens.Lengths(PATH, tokens.frequent(["the of and don't it's a  b\n"], PATH, 50), 100)


def library(text):
    return len(tokens.load(PATH).encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("'stremdvlaZé1²% \n\t\xa0\x85中😀ſ́") | st.characters(exclude_categories=["Cs"]), max_size=20), max_size=5))
def test_counts_are_the_librarys(texts):
    texts = [*texts, "".join(texts), "<|endoftext|>".join(texts), "I'll don't  we've 'tis x'S '' 's"]
    data, offsets = strings(pa.array(texts, pa.string()))
    assert tokens.count_rows(data, offsets, LENGTHS).tolist() == [library(t) for t in texts]


def test_rows(spark, awkward):
    found = tokens.token_counts(awkward, "doc_id", "text", PATH, sample_rows=2, cache=3)
    texts = {repr((r.doc_id, r.text)): (len((r.text or "").encode()), library(r.text)) for r in awkward.collect()}
    assert sorted((r.n_bytes, r.n_tokens) for r in found.collect()) == sorted([*texts.values(), (24, library("hello world this is fine"))])
    assert tokens.token_counts(awkward.limit(0), "doc_id", "text", PATH).collect() == []


def test_query_over_the_table(spark, sf):
    from tidewell.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_token_counts"](spark, sf).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n := library(docs[r.doc_id]), n > 1024)

"""The corpus pipeline: language, lines, near duplicates, benchmark passages, mixing.

Each stage takes the documents that its predecessor kept, as written and read again, and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common, decontam, language, lines, minhash, mixing

#: Five-word shingles and a similarity of 0.8, as for all stages on word shingles.
NEAR = minhash.HyperMinHash(width=5, percent=80, rows=4)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language; `lang` becomes the language found.

    Null, empty and letterless texts are in no language.  Rows that repeat an id share their decision: they stay
    if one of them does.  Null ids are one id.  An empty table gives no rows.
    """
    model = language.fit(docs, "text", "lang")
    given = docs.select("doc_id", "text", F.col("lang").alias("declared"), "source")
    found = language.identify(given, model, "doc_id", "text", declared=F.col("declared"), host=F.col("source"))
    # only what changes has to meet the texts again
    found = _once(found, F.max("kept").alias("kept"), F.max(F.when(F.col("kept"), F.col("lang"))).alias("found"))
    now = docs.select("doc_id", F.col("lang").alias("was"))
    changed = now.join(found, now["doc_id"].eqNullSafe(found["doc_id"])).where(~F.col("kept") | ~F.col("was").eqNullSafe(F.col("found"))).select(found["doc_id"], "kept", "found").distinct()
    changed = common.table(changed, "changed")
    joined = docs.join(common.joinable(changed), _same(docs, changed), "left").where(F.coalesce(changed["kept"], F.lit(True)))
    return joined.select(*((F.coalesce(changed["found"], docs["lang"]) if c == "lang" else docs[c]).alias(c) for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines met before; a document that loses all its lines goes.

    Documents without lines, null texts among them, stay.  Of equal and similar lines, that of the smallest
    (id, position) stays, a null id first.  Repeated rows keep the same lines.  An empty table gives no rows.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = lines.dedup_lines(docs, "doc_id", "text", carry=carry).where("n_kept > 0 or n_lines = 0")
    own = {"doc_id": F.col("id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*(own.get(c, F.col("carried")[c]).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of smallest id.

    Texts without words and null ids are alone in their group and stay.  Rows that repeat an id share their decision:
    they stay if one of them does.  An empty table gives no rows.
    """
    found = _once(minhash.components_by_hyperminhash(docs, "doc_id", "text", NEAR), F.max("kept").alias("kept")).where("not kept")
    return docs.join(common.joinable(found), _same(docs, found), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up 5 % or more go.

    Null and wordless texts stay.  Rows that repeat an id go if one of them is contaminated; null ids are one id.
    An empty table gives no rows, an empty benchmark takes none out.
    """
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id", "text", "item_id", "text")
    found = _once(found.where("contaminated"), F.lit(True).alias("contaminated"))
    return docs.join(common.joinable(found), _same(docs, found), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, with the copies and the words taken of each (in place of columns of these names).

    Documents without words are not in it.  Rows that repeat an id share the decision of the one that is taken most;
    null ids are one id, a null source is a source.  An empty table gives no rows.
    """
    added = ["size", "copies", "taken"]
    one = F.max(F.struct(*added))
    found = _once(mixing.mix_documents(docs, "doc_id", "text", "source").where("taken > 0"), *(one[c].alias(c) for c in added))
    return docs.join(common.joinable(found), _same(docs, found)).select(*(docs[c] for c in docs.columns if c not in added), *(found[c] for c in added))


def _once(found: DataFrame, *columns: Column) -> DataFrame:
    """One row for each id, as a narrow table; rows that repeat an id share the decision."""
    return common.table(found.groupBy(F.col("id").alias("doc_id")).agg(*columns), "decisions")


def _same(docs: DataFrame, found: DataFrame) -> Column:
    """Equal ids; null ids are one id."""
    return docs["doc_id"].eqNullSafe(found["doc_id"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of stage calls, by a mark that each result carries in the metadata of its ids, also once written and read again.
_left: dict[str, list[str]] = {}
_MARK = "stage_call"


def _tidy(stage: Stage) -> Stage:
    """The stage, which removes the scratch tables of the very call that made its `docs`, once these are written, and marks what it returns.

    Results of other calls, of this run or another, keep theirs until they are used so or `common.release` is called.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = docs.schema["doc_id"].metadata.get(_MARK, "")
        if before in _left and not any(root.endswith(path.rpartition("/")[2]) for root in common.roots(docs) for path in _left[before]):
            common.remove(spark, _left.pop(before))
        mark = uuid.uuid4().hex
        with common.scratch(spark, _left.setdefault(mark, [])):
            return stage(spark, docs, sf_dir).withMetadata("doc_id", {_MARK: mark})

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language", _tidy(identify_language)),
    ("lines", _tidy(dedup_lines)),
    ("near_duplicates", _tidy(drop_near_duplicates)),
    ("contamination", _tidy(drop_contaminated)),
    ("mixing", _tidy(mix_sources)),
]

#: Neither language identification nor the closure of fuzzy lines can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again; a written stage goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        made: list[str] = []
        with common.scratch(spark, made):
            docs = common.table(stage(spark, docs, sf_dir), f"stage-{name}")
        kept = made.pop()
        common.remove(spark, made + before)
        before = [kept]
    return STAGES[-1][1](spark, docs, sf_dir)

"""Shared pieces: scratch tables, column guards, one-time bindings."""

from __future__ import annotations

import contextlib
import functools
import gc
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let as let
from ..shipping import ship

#: White space that separates words in the contracts: space and U+0009 to U+000D.
BLANK = r"\x20\x09-\x0D"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_made: dict[str, list[str]] = {}
#: Rows of written tables that were counted once.
_rows: weakref.WeakKeyDictionary[DataFrame, int] = weakref.WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one where it is unset and Spark runs in this process alone (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Cuts the lineage like checkpoint() does, keeps columns prunable, and survives the
    loss of any executor since nothing is held in executor memory or local disks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joinable(found: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A written table of narrow rows as the side of a join: broadcast if it has at most `most` rows, else left to a shuffle."""
    if found not in _rows:
        _rows[found] = found.count()
    return F.broadcast(found) if _rows[found] <= most else found


#: Rows, of a few dozen bytes each, up to which a step is small: 4 million are some 100 MB.
MANY = 1 << 22


def packed(df: DataFrame, rows: int) -> DataFrame:
    """A step over `rows` rows in at most four partitions a core if it is small: many tiny tasks cost more than they compute.  A larger one keeps its partitions."""
    return df.coalesce(4 * max(1, df.sparkSession.sparkContext.defaultParallelism)) if rows <= MANY else df


def only(rows: DataFrame, ids: DataFrame, most: int = 1 << 20) -> DataFrame:
    """`rows` whose id is in `ids` (distinct, a written table): broadcast if there are at most `most`, else by a shuffled semi-join."""
    return rows.join(joinable(ids, most), "id", "left_semi")


def beside(pairs: DataFrame, rows: DataFrame, *columns: str, most: int = 1 << 20) -> DataFrame:
    """`pairs` (a, b) with the `columns` of both ends, as x_a and x_b, from `rows` (id, columns).

    Up to `most` pairs go to the rows, so that only the contents of their ends are shuffled,
    once; an end that many pairs share is then on the broadcast side.  More pairs meet the
    rows in shuffled joins.
    """
    pairs = table(packed(pairs, most), "pairs")
    side = lambda s: rows.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    n = pairs.count()
    if n > most:
        return pairs.join(side("a"), "a").join(side("b"), "b")
    left = side("a").join(F.broadcast(pairs), "a")
    # duplicates on the small side of a semi-join do no harm; few pairs do not need all partitions
    joined = left.join(side("b").join(F.broadcast(pairs.select("b")), "b", "left_semi"), "b")
    return packed(joined, MANY if n <= most >> 3 else n + MANY)


def drop_table(*tables: DataFrame) -> None:
    """Remove scratch tables that `table` wrote and that no later plan reads."""
    for df in tables:
        for path in roots(df):
            _delete(df.sparkSession, path)


def roots(df: DataFrame) -> list[str]:
    """Folders and files that the plan of `df` reads, as they were named; their contents are not listed."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return [str(path) for leaf in found if leaf.nodeName() == "LogicalRelation" for path in _paths(leaf.relation())]


def _paths(relation) -> list:
    location = relation.location().rootPaths()
    return [location.apply(i) for i in range(location.size())]


def sweep(spark: SparkSession) -> None:
    """Shuffle files, broadcasts and generated code of finished steps go when the driver collects its garbage; jobs of hundreds of steps ask for that between them."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession, made: list[str]) -> Iterator[None]:
    """Adds the paths of the scratch tables written meanwhile to `made`."""
    before = len(_made.setdefault(spark.sparkContext.applicationId, []))
    yield
    made += _made[spark.sparkContext.applicationId][before:]


def remove(spark: SparkSession, made: list[str]) -> None:
    """Remove the scratch tables of these paths; the list is empty then."""
    while made:
        _delete(spark, made.pop())


def release(spark: SparkSession) -> None:
    """Remove every scratch table of this application; results not yet consumed become unreadable."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """`df.mapInArrow(run, schema)` with the package on the workers' path.

    Batches are bounded by bytes (or one longer row), as texts differ in length by orders of
    magnitude; a bound that the session has set itself, other than Spark's default, stands.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) in ("64MB", "67108864b", "67108864"):
        conf.set(_BATCH, "8388608b")
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def own_names(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the operator's names: other columns cannot clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in wanted.items()))


@functools.cache
def _blank() -> str:
    return f"[{BLANK}]+"


def count_words(text: Column) -> Column:
    """Number of maximal runs of non-blank characters; 0 for null and blank texts."""
    gaps = F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), _blank(), ""))
    return F.coalesce(gaps, F.lit(0)).cast("long")

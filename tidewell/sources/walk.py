"""Folder trees of any size: each round lists and prunes one level of folders, in tasks."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as tx
from ..operators.scan import MEDIA_SUFFIXES
from ..schemas import flat
from ..shipping import ship
from .folder import LISTING, MARKERS

_LEVEL = "folder string, name string, is_folder boolean, size_bytes bigint, mtime_ns bigint, sidecar boolean"
_BATCH = 4096
_CHUNK = 1 << 20


def _entries(root: str, folder: str, skipped_folders: Sequence[str], skipped_prefixes: tuple[str, ...]) -> Iterator[tuple]:
    """What one folder adds to the walk: nothing if it is a finished bundle, else its media and the folders to go on with."""
    path = os.path.join(root, folder) if folder else root
    with os.scandir(path) as found:
        entries = {e.name: e for e in found}
    if all(m in entries and entries[m].is_file() for m in MARKERS):
        return
    for name, e in entries.items():
        if e.is_symlink():
            continue
        if e.is_dir():
            if name not in skipped_folders and not name.startswith(skipped_prefixes):
                yield folder, name, True, None, None, None
        elif os.path.splitext(name)[1].lower() in MEDIA_SUFFIXES and e.is_file():
            side = entries.get(os.path.splitext(name)[0] + tx.SIDECAR_SUFFIX)
            if side is not None and side.is_symlink():
                continue  # it may lead out of the tree
            held = e.stat()
            yield folder, name, False, held.st_size, held.st_mtime_ns, side is not None and side.is_file()


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_LEVEL_ARROW = pa.schema([("folder", pa.string()), ("name", pa.string()), ("is_folder", pa.bool_()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64()), ("sidecar", pa.bool_())])
_LISTING_ARROW = pa.schema([("relative_path", pa.string()), ("absolute_path", pa.string()), ("sha256", pa.string()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64()), ("sidecar_sha256", pa.string())])


def walk(spark: SparkSession, root: str, skipped_folders: Sequence[str] = (), skipped_prefixes: Sequence[str] = ()) -> DataFrame:
    """(relative_path, size_bytes, mtime_ns, sidecar) of the media files below `root`, by the rules of `folder.media_paths`.

    A round takes the folders of one depth, spreads them over the tasks, and writes what they
    hold; the folders among it are the next round's.  The driver sees a count a round, and there
    are as many rounds as the tree is deep.  Folders that a rule leaves out are never listed.
    """
    ship(spark)
    root = os.path.realpath(root)
    skipped, prefixes = tuple(skipped_folders), tuple(skipped_prefixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for folder in batch.column(0).to_pylist() for row in _entries(root, folder, skipped, prefixes))
        return _batches(found, _LEVEL_ARROW)

    levels = []
    frontier = spark.createDataFrame([("",)], flat("folder string"))
    n = 1
    while n:
        spread = frontier.repartition(min(n, 8 * spark.sparkContext.defaultParallelism))
        level = shared.table(spread.mapInArrow(run, _LEVEL), "level")
        levels.append(level.where("not is_folder"))
        below = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
        frontier = level.where("is_folder").select(below.alias("folder"))
        n = frontier.count()
    files = functools.reduce(DataFrame.unionByName, levels)
    below = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    return files.select(below.alias("relative_path"), "size_bytes", "mtime_ns", "sidecar")


def _digest(path: str) -> tuple[str, int]:
    found, size = hashlib.sha256(), 0
    with open(path, "rb") as file:
        while chunk := file.read(_CHUNK):
            found.update(chunk)
            size += len(chunk)
    return found.hexdigest(), size


def read(spark: SparkSession, root: str, skipped_folders: Sequence[str] = (), skipped_prefixes: Sequence[str] = ()) -> DataFrame:
    """The listing of `folder.read` for a tree of any size: walked in rounds, then hashed file by file in tasks."""
    top = os.path.realpath(root)
    files = walk(spark, root, skipped_folders, skipped_prefixes).select("relative_path", "sidecar")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    path = f"{top}/{name}"
                    sha256, size = _digest(path)
                    yield name, path, sha256, size, os.stat(path).st_mtime_ns, _digest(os.path.splitext(path)[0] + tx.SIDECAR_SUFFIX)[0] if side else None

        return _batches(rows(), _LISTING_ARROW)

    return files.repartition(8 * spark.sparkContext.defaultParallelism).mapInArrow(run, LISTING)


def in_order(listing: DataFrame) -> DataFrame:
    """Rows by the parts of their path, so that a folder's files stand together."""
    return listing.orderBy(F.split("relative_path", "/"))

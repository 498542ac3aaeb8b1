"""Folders of local media as a Spark data source with exact listing rules."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import keys
from ..functions import text as tx
from ..operators.scan import MEDIA_SUFFIXES
from ..schemas import flat
from ..shipping import ship

LISTING = "relative_path string, absolute_path string, sha256 string, size_bytes bigint, mtime_ns bigint, sidecar_sha256 string"
MARKERS = ("manifest.json", "source.json")
_CHUNK = 1 << 20


def digest(path: Path) -> tuple[str, int]:
    """SHA-256 and size of a file of any size, read in chunks."""
    found, size = hashlib.sha256(), 0
    with path.open("rb") as file:
        while chunk := file.read(_CHUNK):
            found.update(chunk)
            size += len(chunk)
    return found.hexdigest(), size


def media_paths(root: Path, skipped_folders: Sequence[str] = (), skipped_prefixes: Sequence[str] = ()) -> Iterator[Path]:
    """Media files below `root` in path order.

    Hidden and underscored names count, suffixes match in any case.  Left out: symbolic links,
    folders of a skipped name or prefix, folders that hold both marker files (finished
    bundles), and files whose sidecar leads outside the root.
    """
    root = root.resolve()
    found = []
    for folder, folders, files in os.walk(root):
        if set(MARKERS) <= set(files):
            folders.clear()
            continue
        folders[:] = [d for d in folders if d not in skipped_folders and not d.startswith(tuple(skipped_prefixes)) and not os.path.islink(f"{folder}/{d}")]
        for name in files:
            path = Path(folder, name)
            if path.suffix.lower() in MEDIA_SUFFIXES and path.is_file() and not path.is_symlink() and _sidecar_inside(path, root):
                found.append(path)
    return iter(sorted(found, key=lambda p: p.relative_to(root).parts))


def sidecar(path: Path) -> Path:
    return path.with_suffix(tx.SIDECAR_SUFFIX)


def _sidecar_inside(path: Path, root: Path) -> bool:
    side = sidecar(path)
    return not side.is_symlink() and (not side.is_file() or side.resolve().is_relative_to(root))


class _Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = Path(options["path"])
        self.folders = [x for x in options.get("skippedfolders", "").split(",") if x]
        self.prefixes = [x for x in options.get("skippedprefixes", "").split(",") if x]
        self.files = int(options.get("filesperpartition", "64"))

    def partitions(self) -> list[InputPartition]:
        one = self.root.is_file()
        paths = [str(self.root.resolve())] if one else [str(p) for p in media_paths(self.root, self.folders, self.prefixes)]
        return [_Slice(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [_Slice([])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        root = self.root.resolve()
        root = root.parent if root.is_file() else root
        for name in partition.paths:
            path = Path(name)
            own, size = digest(path)
            side = sidecar(path)
            yield path.relative_to(root).as_posix(), name, own, size, path.stat().st_mtime_ns, digest(side)[0] if side.is_file() else None


class FolderSource(DataSource):
    """`spark.read.format("media_folder").load(root)`; files are hashed on the executors, which must see the folder."""

    @classmethod
    def name(cls) -> str:
        return "media_folder"

    def schema(self) -> StructType:
        return flat(LISTING)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, root: str, skipped_folders: Sequence[str] = (), skipped_prefixes: Sequence[str] = ()) -> DataFrame:
    """The listing of a folder, or of a single file, which needs no media suffix."""
    ship(spark)
    spark.dataSource.register(FolderSource)
    options = {"skippedFolders": ",".join(skipped_folders), "skippedPrefixes": ",".join(skipped_prefixes)}
    return spark.read.format("media_folder").options(**options).load(root)


def items(listing: DataFrame, source: str) -> DataFrame:
    """Item rows of a listing: ids, and one digest over media and sidecar."""
    return listing.select(
        keys.item_id(F.lit(source), "relative_path").alias("id"), F.lit(source).alias("source_id"), "relative_path", "absolute_path",
        keys.approval_digest("sha256", "sidecar_sha256").alias("sha256"), "size_bytes", "mtime_ns",
    )


def preflight(spark: SparkSession, root: str) -> DataFrame:
    """One row: path, exists, is_dir, readable, media_files (a plain count without exclusions) and ok."""
    path = Path(root)
    is_dir = path.is_dir()
    readable = is_dir and os.access(path, os.R_OK | os.X_OK)
    n = sum(p.suffix.lower() in MEDIA_SUFFIXES and p.is_file() for p in path.rglob("*")) if readable else 0
    rows = spark.createDataFrame([(root, path.exists(), is_dir, readable, n)], "path string, exists boolean, is_dir boolean, readable boolean, media_files bigint")
    return rows.withColumn("ok", F.col("exists") & F.col("is_dir") & F.col("readable"))


def source_status(sources: DataFrame, kind: str, name: str, root: str, policy: str) -> DataFrame:
    """One row `status` for a source to be added: existing if all four agree, conflict if only some of name and root do, else new."""
    same = (F.col("kind") == kind) & (F.col("name") == name) & (F.col("root_path") == root) & (F.col("policy") == policy)
    clash = (F.col("name") == name) | ((F.col("kind") == kind) & (F.col("root_path") == root))
    found = sources.agg(F.coalesce(F.bool_or(same), F.lit(False)).alias("same"), F.coalesce(F.bool_or(clash), F.lit(False)).alias("clash"))
    return found.select(F.when(F.col("same"), "existing").when(F.col("clash"), "conflict").otherwise("new").alias("status"))

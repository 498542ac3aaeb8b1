"""Bundles as folders, written in two phases: tasks write aside, and one rename shows all of them or none."""

from __future__ import annotations

import contextlib
import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import schemas
from ..shipping import ship

_CHUNK = 1 << 20
MANIFEST = "manifest.json"
#: Columns of a row to be written: the name of its folder, its files by path, and its manifest as JSON text.
BUNDLE = "bundle_id string, files map<string,string>, manifest string"


@dataclass
class Written(WriterCommitMessage):
    """The folder of one task attempt."""

    folder: str


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class BundleWriter(DataSourceWriter):
    """Writes below `.writing-<job>`, which no reader lists, and renames that folder to `batch-<job>` once all tasks are done.

    Each task attempt has a folder of its own; those of failed or repeated attempts are removed
    before the rename.  A job that fails, or whose driver dies, shows nothing.
    """

    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), uuid.uuid4().hex
        files, top = _files(self.root)
        files.create_dir(f"{top}/.writing-{self.job}", recursive=True)

    def write(self, rows: Iterator) -> Written:
        files, root = _files(self.root)
        task = TaskContext.get()
        folder = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        aside = f"{root}/.writing-{self.job}"
        # folders are made one by one, so that a task that outlives its job cannot bring the job's folder back
        files.create_dir(f"{aside}/{folder}", recursive=False)
        for row in rows:
            if not row.bundle_id or "/" in row.bundle_id or row.bundle_id.startswith((".", "_")):
                raise ValueError(f"{row.bundle_id!r} cannot name a bundle")
            top = f"{aside}/{folder}/{row.bundle_id}"
            texts = {p: t for p, t in row.files.items() if t is not None}
            texts[MANIFEST] = json.dumps(json.loads(row.manifest), indent=2, ensure_ascii=False) + "\n"
            if any(".." in p.split("/") or p.startswith("/") for p in texts):
                raise ValueError(f"a path of {row.bundle_id!r} leads out of its bundle")
            for made in sorted({"/".join(p.split("/")[:i]) for p in texts for i in range(p.count("/") + 1)}):
                files.create_dir(f"{top}/{made}".rstrip("/"), recursive=False)
            for path, text in texts.items():
                with files.open_output_stream(f"{top}/{path}") as out:
                    out.write(text.encode("utf-8", "surrogatepass"))
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = _files(self.root)
        aside, done = f"{root}/.writing-{self.job}", {m.folder for m in messages if m is not None}
        for entry in files.get_file_info(fs.FileSelector(aside)):
            if entry.base_name not in done:
                files.delete_dir(entry.path)
        files.move(aside, f"{root}/batch-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = _files(self.root)
        aside = f"{root}/.writing-{self.job}"
        for wait in (0.0, 0.2, 0.5, 1.0, 2.0, 4.0):  # tasks of the job may write until they are told to stop
            time.sleep(wait)
            if files.get_file_info(aside).type == fs.FileType.NotFound:
                return
            with contextlib.suppress(OSError):
                files.delete_dir(aside)
        raise OSError(f"{aside} could not be removed")


class BundleFolder(DataSource):
    """`df.write.format("bundle_folder").mode("append").save(root)`; all executors must see the folder."""

    @classmethod
    def name(cls) -> str:
        return "bundle_folder"

    def schema(self) -> str:
        return BUNDLE

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("bundles are never overwritten")
        return BundleWriter(self.options["path"])


def write(rows: DataFrame, root: str) -> None:
    """Write a folder for each row (bundle_id, files, manifest), all or none; bundle ids must differ.

    A file whose content is null is left out, a null or unsafe bundle id or a path that leads out of the bundle fails the job.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(BundleFolder)
    rows.select("bundle_id", "files", "manifest").write.format("bundle_folder").mode("append").save(root)


_SCAN = "bundle_id string, path string, bytes long, sha256 string, manifest string"
_SCAN_ARROW = pa.schema([("bundle_id", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string()), ("manifest", pa.string())])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(bundle_id, path, bytes, sha256, manifest) of every file of the bundles below `root`; only manifests come with their text.

    The driver lists the folders that write tasks left, each of which is then listed and read by
    a task; so the files themselves, three or more a bundle, are never listed in one place.
    """
    from pyarrow import fs

    ship(spark)
    held, top = _files(root)
    parts = []
    for batch in held.get_file_info(fs.FileSelector(top, allow_not_found=True)):
        if batch.base_name.startswith("batch-"):
            parts += [p.path for p in held.get_file_info(fs.FileSelector(batch.path)) if p.base_name.startswith("part-")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, _ = _files(root)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for entry in mine.get_file_info(fs.FileSelector(part, recursive=True)):
                    if entry.type != fs.FileType.File:
                        continue
                    bundle, _, path = entry.path[len(part) + 1 :].partition("/")
                    digest, size, text = hashlib.sha256(), 0, [] if path == MANIFEST else None
                    with mine.open_input_stream(entry.path) as file:
                        while chunk := file.read(_CHUNK):
                            digest.update(chunk)
                            size += len(chunk)
                            if text is not None:
                                text.append(chunk)
                    rows.append((bundle, path, size, digest.hexdigest(), None if text is None else b"".join(text).decode()))
                    if len(rows) == 1024:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    if not parts:
        return spark.createDataFrame([], _SCAN)
    return spark.createDataFrame([(p,) for p in parts], "part string").repartition(len(parts), "part").mapInArrow(run, _SCAN)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCAN_ARROW, strict=True)], schema=_SCAN_ARROW)


def files(spark: SparkSession, root: str) -> DataFrame:
    """(bundle_id, path, bytes, sha256) of the files that bundles hold, their manifests aside."""
    return scan(spark, root).where(F.col("path") != MANIFEST).drop("manifest")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all bundles, with the fixed schema; what `documents.read` gives, but listed in tasks."""
    read = scan(spark, root).where(F.col("path") == MANIFEST)
    return read.select(F.from_json("manifest", schemas.MANIFEST).alias("m")).select("m.*")

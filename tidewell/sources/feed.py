"""A folder as a stream: offsets are numbered listings, so that a restart reads again what it had begun and nothing twice."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import flat
from ..shipping import ship
from .folder import digest, media_paths, sidecar

FEED = "relative_path string, absolute_path string, sha256 string, size_bytes bigint, mtime_ns bigint, sidecar_sha256 string, delta string, listing bigint"


class _Changes(InputPartition):
    def __init__(self, rows: list[tuple[str, str]], listing: int):
        self.rows, self.listing = rows, listing


class Listings:
    """Numbered listings {relative path: [size, mtime_ns, sidecar's mtime_ns]} in a folder; each is created once and never changes."""

    def __init__(self, folder: str):
        self.folder = Path(unquote(urlparse(folder).path) if folder.startswith("file:") else folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def numbers(self) -> list[int]:
        return sorted(int(p.stem) for p in self.folder.glob("[0-9]*.json"))

    def get(self, number: int) -> dict[str, list]:
        return json.loads((self.folder / f"{number:012d}.json").read_text()) if number >= 0 else {}

    def add(self, number: int, listing: dict[str, list]) -> bool:
        """False if another reader has used the number."""
        draft = self.folder / f".draft-{uuid.uuid4().hex}"
        draft.write_text(json.dumps(listing, sort_keys=True))
        try:
            os.link(draft, self.folder / f"{number:012d}.json")
            return True
        except FileExistsError:
            return False
        finally:
            draft.unlink()

    def forget(self, before: int) -> None:
        for n in self.numbers():
            if n < before:
                (self.folder / f"{n:012d}.json").unlink(missing_ok=True)


class FeedReader(DataSourceStreamReader):
    """A new listing is numbered when it differs from the last one; a batch is what differs between two numbers.

    Listings are kept until the batch that ends at a later one is committed, so a batch that is
    planned again after a crash has the same changes.  Files are hashed by the tasks.
    """

    def __init__(self, options: dict[str, str]):
        self.root, self.listings = Path(options["path"]), Listings(options["listings"])
        self.folders = [x for x in options.get("skippedfolders", "").split(",") if x]
        self.prefixes = [x for x in options.get("skippedprefixes", "").split(",") if x]
        self.files = int(options.get("filesperpartition", "64"))

    def _now(self) -> dict[str, list]:
        root, found = self.root.resolve(), {}
        for path in media_paths(self.root, self.folders, self.prefixes):
            held, side = path.stat(), sidecar(path)
            found[path.relative_to(root).as_posix()] = [held.st_size, held.st_mtime_ns, side.stat().st_mtime_ns if side.is_file() else None]
        return found

    def initialOffset(self) -> dict:
        return {"listing": -1}

    def latestOffset(self) -> dict:
        while True:
            last = max(self.listings.numbers(), default=-1)
            now = self._now()
            if now == self.listings.get(last) or self.listings.add(last + 1, now):
                return {"listing": max(self.listings.numbers(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self.listings.get(start["listing"]), self.listings.get(end["listing"])
        rows = [(p, "added" if p not in old else "changed") for p in sorted(new, key=lambda p: p.split("/")) if old.get(p) != new[p]]
        rows += [(p, "removed") for p in sorted(old) if p not in new]
        return [_Changes(rows[i : i + self.files], end["listing"]) for i in range(0, len(rows), self.files)] or [_Changes([], end["listing"])]

    def read(self, partition: _Changes) -> Iterator[tuple]:
        root = self.root.resolve()
        for name, delta in partition.rows:
            path = root / name
            if delta == "removed" or not path.is_file():  # gone since it was listed: the next listing says so
                if delta == "removed":
                    yield name, str(path), None, None, None, None, delta, partition.listing
                continue
            own, size = digest(path)
            side = sidecar(path)
            yield name, str(path), own, size, path.stat().st_mtime_ns, digest(side)[0] if side.is_file() else None, delta, partition.listing

    def commit(self, end: dict) -> None:
        self.listings.forget(end["listing"])


class FolderFeed(DataSource):
    """`spark.readStream.format("media_feed").option("listings", folder).load(root)`."""

    @classmethod
    def name(cls) -> str:
        return "media_feed"

    def schema(self) -> StructType:
        return flat(FEED)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedReader({k.lower(): v for k, v in self.options.items()})


def stream(spark: SparkSession, root: str, listings: str, skipped_folders: tuple[str, ...] = (), skipped_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Added, changed and removed media of a folder as they are found; `listings` is a folder of this stream's own.

    The tree is listed by one process, as a stream's driver plans its batches; for trees that
    are too large for it, `walk.read` and `Engine.scan` list them in tasks.
    """
    ship(spark)
    spark.dataSource.register(FolderFeed)
    options = {"skippedFolders": ",".join(skipped_folders), "skippedPrefixes": ",".join(skipped_prefixes), "listings": listings}
    return spark.readStream.format("media_feed").options(**options).load(root)

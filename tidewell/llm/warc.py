"""WARC archives: writing, normalising whole-file gzip to one member a record, reading by a sidecar index."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, own_names, scratch_path, table

_GZIP = 31  #: zlib's window setting for gzip streams
CHUNK = 1 << 20
INDEX = "path string, offset long, length long, record_id string, kind string"


@dataclass
class Record:
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def dump(self) -> bytes:
        lines = ["WARC/1.1", f"WARC-Type: {self.kind}", *(f"{k}: {v}" for k, v in self.headers.items()), f"Content-Length: {len(self.block)}", "", ""]
        return "\r\n".join(lines).encode() + self.block + b"\r\n\r\n"


def parse_stream(chunks: Iterator[bytes]) -> Iterator[Record]:
    """Records of an uncompressed WARC byte stream; holds one record at a time."""
    held = bytearray()
    more = True

    def need(n: int) -> bool:
        nonlocal more
        while more and len(held) < n:
            chunk = next(chunks, None)
            more = chunk is not None
            held.extend(chunk or b"")
        return len(held) >= n

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not need(seen + 1):
                if held.strip():
                    raise ValueError("WARC stream ends inside a record's header")
                return
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record where one should begin: {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers.pop("Content-Length"))
        if not need(end + 4 + size + 4):
            raise ValueError("WARC stream ends inside a record's block")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]
        yield Record(headers.pop("WARC-Type"), headers, block)


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of gzip bytes, of one member or many, in bounded pieces."""
    engine = zlib.decompressobj(_GZIP)
    for chunk in chunks:
        while chunk:
            if piece := engine.decompress(chunk, CHUNK):
                yield piece
            chunk = engine.unconsumed_tail
            if engine.eof:
                chunk, engine = engine.unused_data, zlib.decompressobj(_GZIP)
    if piece := engine.flush():
        yield piece


def deflate(data: bytes, level: int) -> bytes:
    engine = zlib.compressobj(level, wbits=_GZIP)
    return engine.compress(data) + engine.flush()


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _chunks(stream) -> Iterator[bytes]:
    while chunk := stream.read(CHUNK):
        yield chunk


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared scratch space, as a URI that Spark and Arrow both open."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, tag))
    system = jvm.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(jvm)
    uri = system.makeQualified(jvm).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_monolithic(records: DataFrame, build, folder: str, most: int = 64 << 20, level: int = 1) -> DataFrame:
    """(path, records) of archives written to `folder`, each file one gzip stream over all its records.

    `build` turns a row (dict) into a Record.  A task starts a new file after `most` bytes.
    Names are unique to the attempt, and only files that a successful task has listed count,
    so a lost executor leaves a stray file at worst.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        out = engine = None
        name, size, n = "", 0, 0

        def close() -> pa.RecordBatch:
            out.write(engine.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, engine = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, wbits=_GZIP)
                data = build(row).dump()
                out.write(engine.compress(data))
                size, n = size + len(data), n + 1
                if size >= most:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return table(map_arrow(records, run, "path string, records long"), "archives")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite archives (path) with every record as its own gzip member; returns the index (INDEX).

    Each archive is inflated once as a stream, whatever its members, and records are written
    as they come, so memory holds one record.  Beside each new archive lies its sidecar index
    `<name>.idx`, a JSON line per record with offset, length, id and kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                own, at = _opened(path)
                rows, offset = [], 0
                with own.open_input_stream(at, compression=None) as source, system.open_output_stream(f"{base}/{name}", compression=None) as out, system.open_output_stream(f"{base}/{name}.idx", compression=None) as side:
                    for record in parse_stream(inflate(_chunks(source))):
                        member = deflate(record.dump(), level)
                        out.write(member)
                        row = {"offset": offset, "length": len(member), "record_id": record.headers.get("WARC-Record-ID", ""), "kind": record.kind}
                        side.write(json.dumps(row).encode() + b"\n")
                        rows.append({"path": f"{folder}/{name}"} | row)
                        offset += len(member)
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("kind", pa.string())]))

    n = max(1, archives.count())
    return table(map_arrow(archives.select("path").repartition(n), run, INDEX), "index")


def read_records(index: DataFrame, digest, schema: str) -> DataFrame:
    """`digest(record)` (a dict) of every indexed record, fetched by offset and length and inflated alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if source is not None:
                        source.close()
                    system, at = _opened(row["path"])
                    path, source = row["path"], system.open_input_file(at)
                source.seek(row["offset"])
                rows.append(digest(next(parse_stream(inflate(iter([source.read(row["length"])]))))))
            yield pa.RecordBatch.from_pylist(rows, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return map_arrow(index, run, schema)


# --- records of web pages ---------------------------------------------------------------

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def page_record(row: dict) -> Record:
    """A response with the payload, or a revisit that only refers to one."""
    named = "none" if row["page_id"] is None else row["page_id"]
    headers = {"WARC-Record-ID": f"<urn:page:{named}:{uuid.uuid4().hex}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/http;msgtype=response"}
    if row["page_id"] is not None:
        headers["Page-Id"] = str(row["page_id"])
    if row["url"]:
        headers["WARC-Target-URI"] = "".join(c for c in row["url"] if c.isprintable())
    headers["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    if row["refers_to"] is None:
        return Record("response", headers, _HTTP + row["html"].encode("utf-8", "surrogatepass"))
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{row['refers_to']}>", "Payload-Length": str(row["payload_bytes"])}
    return Record("revisit", headers, _HTTP)


def page_digest(record: Record) -> dict:
    """The contract's columns; a response's digest and size are taken from its payload and must agree with its header."""
    stated = base64.b32decode(record.headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    out = {"page_id": int(record.headers["Page-Id"]) if "Page-Id" in record.headers else None, "record_type": record.kind, "payload_digest": stated}
    if record.kind == "revisit":
        return out | {"payload_bytes": int(record.headers["Payload-Length"]), "refers_to": int(record.headers["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))}
    payload = record.block.partition(b"\r\n\r\n")[2]
    if hashlib.sha1(payload).hexdigest() != stated:
        raise ValueError(f"payload of {record.headers['WARC-Record-ID']} does not match its digest")
    return out | {"payload_bytes": len(payload), "refers_to": None}


def assign(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = 1000) -> DataFrame:
    """Rows with payload_bytes, payload_digest and refers_to; revisits carry no html.

    Of rows with equal payloads of at least `least` bytes, those with the largest id are
    responses and the others, null ids included, refer to it; if all ids are null, all are
    responses.  A null html is an empty payload.  Only digests are grouped, with a map-side
    combined maximum, so a payload shared by a third of all rows makes one group row.
    """
    given = own_names(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce("html", F.lit("")))
    given = given.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1("html")})
    shared = given.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("c")).where("c > 1").drop("c")
    joined = given.join(shared, "payload_digest", "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "payload_bytes", "payload_digest", F.when(again, F.col("top")).alias("refers_to"))


def round_trip(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Write every page as a WARC record, normalise the archives, and read all records back (PAGE).

    Pages go into whole-file gzip archives in the shared scratch folder, the normaliser rewrites
    them with one member a record and an index, and the rows come from the members at the
    indexed places.  Repeated rows are separate records; extra columns are ignored; an empty
    table writes nothing and gives no rows.
    """
    spark = pages.sparkSession
    archives = write_monolithic(assign(pages, id_col, url_col, html_col), page_record, shared_folder(spark, "warc"))
    index = normalise(archives, shared_folder(spark, "warc-members"))
    return read_records(index, page_digest, PAGE)

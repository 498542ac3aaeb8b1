"""Fixed schemas of the registry, queue, library and documents, and the constraints on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE_VERSION = 1

# The states, policies and kinds that records may hold.
QUEUE_STATES = ("discovered", "approved", "skipped", "failed", "completed")
POLICIES = ("disabled", "scan-only", "review")
REGISTRY_KINDS = ("local-folder", "one-shot")
BUNDLE_KINDS = ("youtube", "local", "url")
STAGES = ("acquire", "normalize", "transcribe", "diarize", "visual", "enrich", "situate", "synthesize")
STAGE_STATES = ("pending", "running", "done", "failed", "skipped")

_TYPES = {"string": T.StringType, "timestamp": T.TimestampType, "bigint": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType}


def flat(text: str) -> T.StructType:
    """A schema of plain columns from `name type, ...`; needs no session."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in pairs])


_ddl = flat
SOURCES = _ddl("id string, kind string, name string, root_path string, policy string, created_at timestamp, updated_at timestamp")
ITEMS = _ddl("id string, source_id string, relative_path string, absolute_path string, sha256 string, size_bytes bigint, mtime_ns bigint, present boolean, created_at timestamp, updated_at timestamp")
QUEUE = _ddl("id string, source_id string, source_item_id string, content_sha256 string, state string, policy string, bundle_id string, attempts int, last_error string, created_at timestamp, updated_at timestamp")
LIBRARY = _ddl("bundle_id string, bundle_path string, source_id string, source_item_id string, queue_item_id string, created_at timestamp")
SEGMENT = _ddl("id int, start_s double, end_s double, text string, source string")
ARTIFACT = _ddl("path string, sha256 string, bytes bigint")
STAGE = T.StructType([T.StructField("state", T.StringType()), T.StructField("started", T.TimestampType()), T.StructField("finished", T.TimestampType()), T.StructField("outputs", T.ArrayType(ARTIFACT)), T.StructField("error", T.StringType())])
MANIFEST = T.StructType([
    T.StructField("schema_version", T.StringType()), T.StructField("bundle_id", T.StringType()), T.StructField("created", T.TimestampType()),
    T.StructField("source", _ddl("kind string, ref string, title string, channel string, published timestamp, duration_s double")),
    T.StructField("stages", T.MapType(T.StringType(), STAGE)),
])


def export(schema: T.StructType) -> str:
    """The schema as JSON text."""
    return schema.json()


#: JSON Schema of plain Spark types.
_JSON = {"string": {"type": "string"}, "timestamp": {"type": "string", "format": "date-time"}, "bigint": {"type": "integer"}, "int": {"type": "integer"}, "double": {"type": "number"}, "boolean": {"type": "boolean"}}


def json_schema(kind: T.DataType) -> dict:
    """A JSON Schema of the documents that a type describes; every field may be null."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: _nullable(json_schema(f.dataType)) for f in kind}, "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    return dict(_JSON[kind.simpleString()])


def _nullable(schema: dict) -> dict:
    return {"anyOf": [schema, {"type": "null"}]}


def manifest_contract() -> dict:
    """The JSON Schema that a manifest document must hold to: what is required, what may be null, and which values are allowed."""
    text, number, whole, time = {"type": "string"}, {"type": "number"}, {"type": "integer"}, {"type": "string", "format": "date-time"}
    one_of = lambda values: {"type": "string", "enum": list(values)}
    record = lambda required, **fields: {"type": "object", "properties": fields, "required": list(required)}
    artifact = record(("path", "sha256", "bytes"), path=text, sha256=text, bytes=whole)
    source = record(("kind", "ref"), kind={"$ref": "#/$defs/SourceKind"}, ref=text, title=_nullable(text), channel=_nullable(text), published=_nullable(time), duration_s=_nullable(number))
    outputs = {"type": "array", "items": {"$ref": "#/$defs/ArtifactRef"}}
    stage = record((), state={"$ref": "#/$defs/StageState"}, started=_nullable(time), finished=_nullable(time), outputs=outputs, error=_nullable(text))
    stages = {"type": "object", "propertyNames": {"$ref": "#/$defs/StageName"}, "additionalProperties": {"$ref": "#/$defs/StageRecord"}}
    defs = {"ArtifactRef": artifact, "Source": source, "SourceKind": one_of(BUNDLE_KINDS), "StageName": one_of(STAGES), "StageRecord": stage, "StageState": one_of(STAGE_STATES)}
    return {"$defs": defs} | record(("bundle_id", "source"), schema_version=text, bundle_id=text, created=time, source={"$ref": "#/$defs/Source"}, stages=stages)


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that break uniqueness, with their counts."""
    return rows.groupBy(*key).count().where("count > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose `column` names no parent; null names none and is allowed."""
    named = rows.where(F.col(column).isNotNull())
    return named.join(parents.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def strange(rows: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Rows whose `column` holds none of the allowed values."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def version_status(found: int | None) -> str:
    """`fresh` for a new state, `ok` for the known version, else `unsupported`."""
    return {0: "fresh", None: "fresh", STATE_VERSION: "ok"}.get(found, "unsupported")

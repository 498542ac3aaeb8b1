"""JSON Schemas compiled to expressions that list what a document does against them."""

from __future__ import annotations

import functools
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from .segments import NUMBERS, kind

Schema = Mapping[str, Any]
_NONE = "array<struct<path:string,rule:string>>"
#: Rules that bear on values of any type, or on scalars.
_OF_ANY = {"anyOf", "enum", "const", "minLength", "pattern", "minimum", "maximum", "format"}
_INTEGERS = r"^(TINYINT|SMALLINT|INT|BIGINT)$"


def _found(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def _none() -> Column:
    return F.array().cast(_NONE)


def _unless(good: Column, path: Column, rule: str) -> Column:
    return F.when(good, _none()).otherwise(_found(path, rule))


def _is(value: Column, shown: Column, name: str) -> Column:
    """Whether a VARIANT of the shape `shown` is of a JSON type; whole decimal numbers are integers."""
    if name == "integer":
        whole = F.try_variant_get(value, "$", "decimal(38,0)")
        exact = F.try_variant_get(value, "$", "double")
        return shown.rlike(_INTEGERS) | (shown.rlike(NUMBERS) & (whole.cast("double") == exact))
    plain = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
    if name in plain:
        return shown == plain[name]
    return shown.rlike(NUMBERS) if name == "number" else kind(value, shown) == {"array": "list"}.get(name, name)


def _field(value: Column, name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(value, f'$["{quoted}"]', "variant")


def _target(schema: Schema, root: Schema) -> Schema:
    """What a local $ref stands for."""
    while "$ref" in schema:
        target: Any = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        schema = target
    return schema


def violations(value: Column, schema: Schema, path: Column | str = "$", root: Schema | None = None) -> Column:
    """array<struct<path, rule>> of all that a VARIANT does against a JSON Schema; empty if it holds.

    Understands type, enum, const, required, properties, additionalProperties, propertyNames
    with enum, items, minItems, minimum, maximum, minLength, pattern, format date-time, anyOf
    and local $ref.  A value of the wrong type is reported as that alone.  Schemas are constants of
    the plan and must not refer to themselves, so the check is one expression without a shuffle.
    `value` should be a column or a bound variable: every value below it is taken out, and its kind found, once.
    """
    path = F.lit(path) if isinstance(path, str) else path
    root = root or schema
    schema = _target(schema, root)
    wrong = _found(path, "type")
    # a value that can be read as an object or a list is one: its shape, which takes a walk over all that is in it, is not needed
    if schema.get("type") == "object" and not schema.keys() & _OF_ANY:
        named = _named(schema)
        if named:
            return let(F.try_variant_get(value, "$", named), lambda fields: F.when(fields.isNull(), wrong).otherwise(_object(value, fields, schema, path, root)))
        if not schema.get("properties") and not schema.get("required"):
            return let(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda members: F.when(members.isNull(), wrong).otherwise(_members(members, schema, path, root)))
    if schema.get("type") == "array" and not schema.keys() & _OF_ANY:
        return let(F.try_variant_get(value, "$", "array<variant>"), lambda listed: F.when(listed.isNull(), wrong).otherwise(_listed(listed, schema, path, root)))
    return let(F.schema_of_variant(value), lambda shown: _violations(value, shown, schema, path, root))


def _named(schema: Schema) -> str | None:
    """The properties that a schema names, as a struct; none if it names none, or two that differ in case alone."""
    names = list(schema.get("properties", {}))
    return f"struct<{','.join(f'`{n.replace('`', '``')}`:variant' for n in names)}>" if names and len({n.lower() for n in names}) == len(names) else None


def _object(value: Column, fields: Column, schema: Schema, path: Column, root: Schema) -> Column:
    """What an object does, whose named properties are `fields`."""
    below = lambda name: F.concat(path, F.lit(f".{name}"))
    required = schema.get("required", ())
    parts = [F.when(_field(value, n).isNull(), _found(below(n), "required")).otherwise(_none()) for n in required if n not in schema["properties"]]
    for name, inner in schema["properties"].items():
        absent = _found(below(name), "required") if name in required else _none()
        parts.append(F.when(fields.getField(name).isNotNull(), violations(fields.getField(name), inner, below(name), root)).otherwise(absent))
    return F.concat(*parts, *_others(value, schema, path, root))


def _others(value: Column, schema: Schema, path: Column, root: Schema) -> list[Column]:
    """What the names of an object and the properties that its schema does not name do, if the schema tells of them."""
    if "propertyNames" not in schema and schema.get("additionalProperties", True) is True:
        return []
    return [let(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda members: _members(members, schema, path, root))]


def _violations(value: Column, shown: Column, schema: Schema, path: Column, root: Schema) -> Column:
    parts: list[Column] = []
    below = lambda name: F.concat(path, F.lit(f".{name}"))
    text = F.try_variant_get(value, "$", "string")
    if "anyOf" in schema:
        # all ways are over this very value
        ways = [F.size(_violations(value, shown, _target(s, root), path, root)) == 0 for s in schema["anyOf"]]
        parts.append(_unless(functools.reduce(lambda a, b: a | b, ways), path, "anyOf"))
    strings, numbers = _is(value, shown, "string"), _is(value, shown, "number")
    if "enum" in schema:
        parts.append(_unless(F.coalesce(strings & text.isin(*schema["enum"]), F.lit(False)), path, "enum"))
    if "const" in schema:
        parts.append(_unless(F.coalesce(strings & (text == schema["const"]), F.lit(False)), path, "const"))
    number = F.try_variant_get(value, "$", "double")
    for key, test in (
        ("minLength", lambda n: ~strings | (F.length(text) >= n)), ("pattern", lambda p: ~strings | text.rlike(p)),
        ("minimum", lambda n: ~numbers | (number >= n)), ("maximum", lambda n: ~numbers | (number <= n)),
    ):
        if key in schema:
            parts.append(_unless(test(schema[key]), path, key))
    if schema.get("format") == "date-time":
        shape = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
        parts.append(_unless(~strings | (shape & F.try_to_timestamp(F.upper(text)).isNotNull()), path, "format"))
    for name in schema.get("required", ()):
        parts.append(F.when(_is(value, shown, "object") & _field(value, name).isNull(), _found(below(name), "required")).otherwise(_none()))
    for name, inner in schema.get("properties", {}).items():
        parts.append(_property(_field(value, name), inner, below(name), root))
    parts += _others(value, schema, path, root)
    if "items" in schema or "minItems" in schema:
        parts.append(let(F.try_variant_get(value, "$", "array<variant>"), lambda listed: _listed(listed, schema, path, root)))
    inside = F.concat(*parts) if parts else _none()
    if "type" not in schema:
        return inside
    names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
    fits = functools.reduce(lambda a, b: a | b, (_is(value, shown, n) for n in names))
    return F.when(F.coalesce(fits, F.lit(False)), inside).otherwise(_found(path, "type"))


def _property(value: Column, schema: Schema, path: Column, root: Schema) -> Column:
    """What the value of a property does, if there is one."""
    return let(value, lambda x: F.when(x.isNotNull(), violations(x, schema, path, root)).otherwise(_none()))


def _members(members: Column, schema: Schema, path: Column, root: Schema) -> Column:
    """What the names of an object and the properties that the schema does not name do against it."""
    parts: list[Column] = []
    at = lambda e: F.concat(path, F.lit("."), e["key"])
    if "propertyNames" in schema:
        strange = F.filter(members, lambda e: ~e["key"].isin(*_target(schema["propertyNames"], root)["enum"]))
        parts.append(F.coalesce(F.transform(strange, lambda e: F.struct(at(e).alias("path"), F.lit("propertyNames").alias("rule"))), _none()))
    more = schema.get("additionalProperties", True)
    if more is not True:
        others = F.filter(members, lambda e: ~e["key"].isin(*schema["properties"])) if schema.get("properties") else members
        each = (lambda e: _found(at(e), "additionalProperties")) if more is False else (lambda e: let(e["value"], lambda x: violations(x, more, at(e), root)))
        parts.append(F.coalesce(F.flatten(F.transform(others, each)), _none()))
    return F.concat(*parts) if parts else _none()


def _listed(listed: Column, schema: Schema, path: Column, root: Schema) -> Column:
    """What a list and its items do against the schema."""
    parts: list[Column] = []
    if "items" in schema:
        each = lambda x, i: violations(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), root)
        parts.append(F.coalesce(F.flatten(F.transform(listed, each)), _none()))
    if "minItems" in schema:
        parts.append(_unless(listed.isNull() | (F.size(listed) >= schema["minItems"]), path, "minItems"))
    return F.concat(*parts) if parts else _none()


def check(documents: DataFrame, key: str, column: str, schema: Schema) -> DataFrame:
    """(key, path, rule): a row for each violation in a column of JSON texts; a text that is no JSON gives path $ and rule json."""
    found = lambda v: F.when(v.isNull(), _found(F.lit("$"), "json")).otherwise(violations(v, schema))
    return documents.select(key, F.inline(let(F.try_parse_json(F.col(column)), found)))

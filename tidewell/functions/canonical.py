"""JSON texts in one canonical form, as Python writes it, for identities that must agree byte by byte."""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def encode(text: str | None, compact: bool = True, ascii_only: bool = True) -> str | None:
    """Sorted keys, escapes and shortest floats; of repeated keys the last counts, NaN and infinities are numbers.  None if it is no JSON."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return json.dumps(value, sort_keys=True, separators=(",", ":") if compact else None, ensure_ascii=ascii_only)


def _finite(value):
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def strict(text: str | None) -> str | None:
    """JSON that every parser takes: of repeated keys the last one is left, and what is no finite number is null.  None if it is no JSON."""
    if text is None:
        return None
    try:
        return json.dumps(_finite(json.loads(text)), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def lenient(text: Column | str) -> Column:
    """`strict` of a column, in Arrow batches: for payloads of tools whose JSON holds NaN or repeats keys."""
    return _mapped(text, strict)


def canonical(text: Column | str, compact: bool = True, ascii_only: bool = True) -> Column:
    """`encode` of a column, in Arrow batches: the escapes and floats of another language cannot be built from SQL functions alone.

    Nulls, and texts that are no JSON, are null.  `compact` leaves out blanks after commas and colons.
    """
    return _mapped(text, functools.partial(encode, compact=compact, ascii_only=ascii_only))


def _mapped(text: Column | str, one: Callable[[str | None], str | None]) -> Column:
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one(None if pd.isna(t) else t))

    return run(F.col(text) if isinstance(text, str) else text)

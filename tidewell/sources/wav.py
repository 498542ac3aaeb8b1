"""WAV headers out of binary content."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

# The canonical audio of a transcript.
CHANNELS, RATE, SAMPLE_BYTES = 1, 16_000, 2
HEADER = "readable boolean, channels int, rate int, sample_bytes int, seconds double"


def header(content: bytes | None) -> tuple[bool, int | None, int | None, int | None, float | None]:
    """Whether `content` is a PCM WAV, its format, and its length: whole frames of the data chunk over the rate."""
    bad = (False, None, None, None, None)
    if content is None or len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return bad
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(content):
                return bad
            tag, channels, rate, _, frame, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            if tag not in (1, 0xFFFE) or not channels or not bits:
                return bad
            form = channels, rate, (bits + 7) // 8
        elif name == b"data":
            if form is None:
                return bad
            channels, rate, width = form
            frames = size // (channels * width)
            return True, channels, rate, width, frames / rate if rate > 0 else None
        at += 8 + size + size % 2
    return bad


def probe(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` with a `wav` structure (HEADER) in place of the content."""
    ship(files.sparkSession)

    @F.pandas_udf(HEADER)
    def parsed(column: pd.Series) -> pd.DataFrame:
        rows = [header(None if c is None else bytes(c)) for c in column]
        return pd.DataFrame(rows, columns=["readable", "channels", "rate", "sample_bytes", "seconds"]).astype({"channels": "Int32", "rate": "Int32", "sample_bytes": "Int32"})

    return files.withColumn("wav", parsed(F.col(content))).drop(content)


def is_canonical(wav: Column) -> Column:
    same = (wav["channels"] == CHANNELS) & (wav["rate"] == RATE) & (wav["sample_bytes"] == SAMPLE_BYTES)
    return wav["readable"] & F.coalesce(same, F.lit(False))


def needs_normalising(wav: Column) -> Column:
    return ~is_canonical(wav)

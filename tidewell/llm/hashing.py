"""Vectorised word hashing over whole Arrow string columns.

A batch is one byte buffer; words, their 64-bit hashes and the rows they lie in come from
a handful of array passes, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes outside words: white space only, and all of ASCII but letters and digits.
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (_BASE, inverse))
    return _powers


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes, or of a single longer row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(to, n)
        row = min(to, n)


def rolling(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each slice of `points`, all from one pass of sums."""
    up, down = _powers_to(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    hashes: np.ndarray  #: of each word, in order
    starts: np.ndarray  #: byte offset of each word
    ends: np.ndarray
    rows: np.ndarray  #: first word of each row; one more entry than rows


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> Words:
    """Words of the rows of one piece, lower-cased from A to Z; `outside` tells the bytes between words."""
    gap = outside[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    return Words(rolling(LOWER[data], starts, ends), starts, ends, np.searchsorted(starts, offsets))


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of each sequence, given the hashes of its first, second, ... members."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = mix(out * _BASE + part)
    return out


def couple_keys(hashes: np.ndarray, offsets: np.ndarray, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of `rows` of sorted sets: keys that any two linked sets share, whatever their size, the pairs of hashes of a prefix.

    Linked sets share at least `percent` % of either one, s of its n members, and so the first
    two of those lie among the first n - s + 2 of both.  A set of one member links only to its equals.
    """
    n = np.diff(offsets)[rows]
    found = [(rows[n == 1], hashes[offsets[rows[n == 1]]])]
    for size in np.unique(n[n > 1]).tolist():
        own = rows[n == size]
        x, y = np.triu_indices(min(size, size + (-percent * size) // 100 + 2), 1)
        pairs = [hashes[(offsets[own][:, None] + side[None, :]).ravel()] for side in (x, y)]
        found.append((np.repeat(own, len(x)), chain(pairs)))
    return np.concatenate([r for r, _ in found]), np.concatenate([k for _, k in found])

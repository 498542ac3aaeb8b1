"""Fill-in-the-middle: texts cut at unit ends that rank and select find in packed bit vectors.

The unit ends of a piece of texts are one bit vector, a bit for each byte, packed eight to a
byte, with a directory of the bits before each block.  Rank counts the bits before a byte,
select finds the byte of the k-th bit; together they give the number of units of a text and
the bytes at which its prefix and middle end, without a list of units.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, own_names
from .hashing import pieces, strings

#: The marks around prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
#: Bits of each byte value, and the place of its k-th one (k from 0; 8 where it has fewer).
_COUNT = _ONES.sum(axis=1).astype(np.uint8)
_KTH = np.array([[*np.flatnonzero(row).tolist(), *[8] * 8][:8] for row in _ONES], np.uint8)
#: Bytes of a directory block.
_BLOCK = 64


class Bits:
    """A packed bit vector with a directory of popcounts: an eighth of a byte a bit, and eight bytes a block of 512 bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits)
        self.packed = np.concatenate([packed, np.zeros(-len(packed) % _BLOCK + _BLOCK, np.uint8)])
        self.before = np.concatenate([[0], np.cumsum(_COUNT[self.packed].reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits before each place."""
        byte, block = at >> 3, at >> 9
        out = self.before[block]
        inside = _COUNT[self.packed[(block * _BLOCK)[:, None] + np.arange(_BLOCK)]] * (np.arange(_BLOCK) < (byte - block * _BLOCK)[:, None])
        head = self.packed[byte] & ~(np.uint8(255) >> (at & 7).astype(np.uint8))
        return out + inside.sum(axis=1, dtype=np.int64) + _COUNT[head]

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of each k-th bit, counted from 0; there must be as many."""
        block = np.searchsorted(self.before, k, "right") - 1
        counts = np.cumsum(_COUNT[self.packed[(block * _BLOCK)[:, None] + np.arange(_BLOCK)]], axis=1, dtype=np.int64)
        left = k - self.before[block]
        byte = (counts <= left[:, None]).sum(axis=1)
        left = left - np.where(byte > 0, counts[np.arange(len(k)), byte - 1], 0)
        byte = block * _BLOCK + byte
        return byte * 8 + _KTH[self.packed[byte], left]


@dataclass(frozen=True)
class Infill:
    """`rate` percent of the texts are cut, `spm` percent of these with the suffix first; `seed` varies the cuts."""

    seed: int = 7
    rate: int = 100
    spm: int = 50


def _cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a piece: its units, the bytes where prefix and middle end, and the code points of both."""
    start, end = offsets[:-1], offsets[1:]
    bits = data == 10
    bits[end[end > start] - 1] = True
    ends = Bits(bits)
    first = ends.rank(start)
    n = ends.rank(end) - first
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))

    def byte(k: np.ndarray) -> np.ndarray:
        out = start.copy()
        some = k > 0
        out[some] = ends.select((first + k - 1)[some]) + 1
        return out

    a, b = byte(low), byte(high)
    points = Bits((data & 0xC0) != 0x80)
    at = points.rank(a)
    return n, a, b, at - points.rank(start), points.rank(b) - at


def _marked(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold a mark."""
    out = np.zeros(len(offsets) - 1, bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        at = data.find(mark.encode())
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(mark) <= offsets[row + 1]:
                out[row] = True
                at = data.find(mark.encode(), int(offsets[row + 1]))
            else:  # it straddles two rows
                at = data.find(mark.encode(), at + 1)
    return out


def infill(docs: DataFrame, id_col: str, text_col: str, given: Infill | None = None) -> DataFrame:
    """Per row: id, n, form, prefix_chars, middle_chars, output.

    A text is cut into n units, each up to a line feed or the end.  Two numbers drawn from its
    id choose how many units the prefix and the middle end after.  `form` is psm (prefix,
    suffix, middle, each after its mark), spm (suffix first) or plain: the text as it is, if it
    is empty, holds a mark, or is not among the `rate` percent that are cut; plain texts have
    null lengths.

    Null texts count as empty.  Rows are independent: repeated rows give equal outputs, a null
    id draws like an empty one.  A text of any length is held a few times by one task, with a
    bit for each byte; shorter texts are taken in pieces of about a megabyte.  Extra columns
    are ignored; an empty table gives no rows.
    """
    given = given or Infill()
    digest = F.sha2(F.concat(F.lit(f"{given.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    draws = (F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4))
    rows = own_names(docs, id=id_col, text=text_col).select("id", "text", *draws)
    rate, spm = given.rate, given.spm
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            drawn = [batch.column(i).to_numpy() for i in range(2, 6)]
            for lo, hi in pieces(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                part = data[offsets[lo] : offsets[hi]]
                whole = part.tobytes()
                h1, h2, h3, h4 = (h[lo:hi] for h in drawn)
                n, a, b, before, middle = _cuts(part, at, h1, h2)
                plain = (at[1:] == at[:-1]) | (h3 % 100 >= rate) | _marked(whole, at)
                first = h4 % 100 < spm
                out = []
                for i, (x, y, u, v) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), a.tolist(), b.tolist(), strict=True)):
                    if plain[i]:
                        out.append(whole[x:y])
                    elif first[i]:
                        out.append(b"".join((s, whole[v:y], p, whole[x:u], m, whole[u:v])))
                    else:
                        out.append(b"".join((p, whole[x:u], s, whole[v:y], m, whole[u:v])))
                form = np.where(plain, "plain", np.where(first, "spm", "psm"))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(form.tolist(), pa.string()),
                    pa.array(before, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).view(pa.string()),
                ], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; cut texts hold no mark, so the first of each kind divides it."""
    before = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substr(text, F.length(before(text, mark)) + len(mark) + 1)
    psm = F.concat(after(before(output, SUFFIX), PREFIX), after(output, MIDDLE), after(before(output, MIDDLE), SUFFIX))
    spm = F.concat(after(before(output, MIDDLE), PREFIX), after(output, MIDDLE), after(before(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

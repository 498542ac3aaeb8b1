"""Exact token counts by a two-tier lookup of pre-token lengths, without any shuffle."""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, own_names
from .hashing import _powers_to, mix, pieces, strings

OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)
# The white-space characters of the byte-level pre-tokenizer (Unicode White_Space).
SPACES = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The endings that the byte-level pre-tokenizer splits after an apostrophe.
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point; those unassigned here, which the tokenizer's own tables may know, are UNSURE."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([UNSURE if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], OTHER) for i in range(0x110000)], np.uint8)
    table[SPACES] = SPACE
    return table


def pre_tokens(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Start flags of the byte-level pre-tokens of concatenated rows of code points.

    Runs of one class are pre-tokens; the last character of a white-space run before other
    text stands alone, and if it is a plain space joins what follows; an apostrophe alone
    takes one of its endings with it.
    """
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[rows] = first[n] = True
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start |= first
    last = np.flatnonzero((kind == SPACE) & start[1:] & ~first[1:])  # ends a run of white space, text follows
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    mark = np.flatnonzero((points == 0x27) & start[:-1])
    mark = mark[~first[mark + 1]]
    mark = mark[kind[mark + 1] == LETTER]
    one = mark[np.isin(points[mark + 1], [ord(c) for c in ENDINGS_1])]
    two = mark[~first[mark + 2]]
    two = two[np.isin(points[two + 1].astype(np.int64) << 21 | points[two + 2], [ord(a) << 21 | ord(b) for a, b in ENDINGS_2])]
    for at, size in ((one, 2), (two, 3)):
        start[at + 1] = False
        start[at + size] = True
    return start[:-1]


class Lengths:
    """Token counts of pre-tokens: a compact table of frequent ones, then a cache of what this worker has met."""

    def __init__(self, path: str, table: tuple[np.ndarray, np.ndarray], cache: int):
        self.tokenizer = load(path)
        self.specials = [str(t).encode() for t in map(lambda t: t.content, self.tokenizer.get_added_tokens_decoder().values())]
        self.keys, self.sizes = table
        self.down = np.uint64(65 - len(self.keys).bit_length())
        self.cache, self.most = {}, cache

    def of(self, hashes: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        at = (hashes >> self.down).astype(np.int64)
        open_ = np.arange(len(hashes))
        for _ in range(PROBES):
            same = self.keys[at] == hashes[open_]
            out[open_[same]] = self.sizes[at[same]]
            open_, at = open_[~same], (at[~same] + 1) % len(self.keys)
            if not len(open_):
                return out
        unique, where, back = np.unique(hashes[open_], return_index=True, return_inverse=True)
        found = np.array([self.cache.get(h, 0) for h in unique.tolist()], np.int64)
        new = np.flatnonzero(found == 0)
        if len(new):
            which = open_[where[new]]
            got = [len(e.ids) for e in self.tokenizer.encode_batch([text[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)], add_special_tokens=False)]
            found[new] = got
            if len(self.cache) + len(new) > self.most:
                self.cache.clear()
            self.cache.update(zip(unique[new].tolist(), got, strict=True))
        out[open_] = found[back]
        return out


#: Places of the frequent table that a lookup tries.
PROBES = 4


def compact(counted: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Open-addressing arrays (hash, length) filled to a quarter; what finds no place within PROBES is left out."""
    size = 1 << max(10, (4 * len(counted)).bit_length())
    keys, sizes, down = np.zeros(size, np.uint64), np.zeros(size, np.uint16), 65 - size.bit_length()
    for h, n in counted:
        at = h >> down
        for i in range(PROBES):
            j = (at + i) % size
            if not keys[j] and h and n < 65536:
                keys[j], sizes[j] = h, n
                break
    return keys, sizes


@functools.cache
def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _hashed(points: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(points))
    up, down = _powers_to(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts, ends


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def frequent(texts: list[str], path: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The compact table of the `most` most frequent pre-tokens of `texts`."""
    seen: Counter[str] = Counter()
    for text in texts:
        points = _points(text)
        if len(points):
            starts = np.flatnonzero(pre_tokens(points, np.array([0])))
            seen.update(text[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(text)], strict=True))
    top = [t for t, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]]
    counts = [len(e.ids) for e in load(path).encode_batch(top, add_special_tokens=False)]
    hashes = [int(_hashed(_points(t), np.arange(len(t)) == 0)[0][0]) for t in top]
    return compact(list(zip(hashes, counts, strict=True)))


_lengths: dict[str, Lengths] = {}


def count_rows(data: np.ndarray, offsets: np.ndarray, lengths: Lengths) -> np.ndarray:
    """Tokens of each row of one piece."""
    whole = data.tobytes()
    n = len(offsets) - 1
    out = np.zeros(n, np.int64)
    aside = np.zeros(n, bool)  # rows for the library itself: special strings, characters of unsure class, bad bytes
    for special in lengths.specials:
        at = whole.find(special)
        while at >= 0:
            aside[np.searchsorted(offsets, at, "right") - 1] = True
            at = whole.find(special, at + 1)
    try:
        text = whole.decode()
    except UnicodeDecodeError:
        text, aside[:] = "", True
    if text:
        points = _points(text)
        rows = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        unsure = np.flatnonzero(classes()[points] == UNSURE)
        aside[np.searchsorted(rows, unsure, "right") - 1] = True
        hashes, starts, ends = _hashed(points, pre_tokens(points, rows[:-1]))
        total = np.concatenate([[0], np.cumsum(lengths.of(hashes, text, starts, ends))])
        out = np.diff(total[np.searchsorted(starts, rows)])
    for i in np.flatnonzero(aside).tolist():
        out[i] = len(lengths.tokenizer.encode(whole[offsets[i] : offsets[i + 1]].decode(errors="replace"), add_special_tokens=False).ids)
    return out


def token_counts(docs: DataFrame, id_col: str, text_col: str, path: str, sample_rows: int = 1000, sample_chars: int = 20_000, most: int = 1 << 15, cache: int = 1 << 20) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, as the tokenizer file at `path` (byte-level) gives them.

    Texts are cut into pre-tokens by array operations; the length of each comes from a
    broadcast table of frequent ones (at most `most` entries, 0.1 to 2.5 MB), else from the
    worker's cache, else from the library.  No pre-token is shuffled and no count is
    estimated: the table, made from the first `sample_rows` texts of at most `sample_chars`
    characters, only saves work.  Rows that hold special strings, characters of unsure class
    or bad UTF-8 are encoded whole by the library.

    Null texts count as empty: 0 bytes, 0 tokens.  Ids, null or repeated, are carried as they
    are; extra columns are ignored.  An empty table gives no rows.  The tokenizer file must
    be readable at `path` on every worker.
    """
    given = own_names(docs, id=id_col, text=text_col)
    texts = [r.text for r in given.where(F.length("text") <= sample_chars).select("text").head(sample_rows)]
    table, name = docs.sparkSession.sparkContext.broadcast(frequent(texts, path, most)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _lengths:
            _lengths.clear()
            _lengths[name] = Lengths(path, table.value, cache)
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in pieces(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                counts = count_rows(data[offsets[lo] : offsets[hi]], at, _lengths[name])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    kind = given.schema["id"].dataType.simpleString()
    return map_arrow(given, run, f"id {kind}, n_bytes long, n_tokens long")

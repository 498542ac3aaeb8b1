"""Benchmark passages inside documents, found by Wu-Manber search over words."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, own_names
from .hashing import LOWER, MARKS, Words, chain, pieces, strings, words

#: Words that one lane of the scan walks; lanes advance together, one array step for all.
LANE = 512


class Scanner:
    """All patterns of one length: shift table by block, buckets by suffix (and prefix) block, then direct comparison.

    The alphabet is words, a block is two neighbouring words (one if patterns have one word).
    The shift of a block is how far the scan may jump if the window ends with it; blocks that
    end some pattern have shift 0 and lead to a bucket of patterns with that last block.
    """

    def __init__(self, length: int, patterns: list[tuple[list[bytes], np.ndarray, set[str]]]):
        self.length, self.block = length, min(2, length)
        self.words = [p[0] for p in patterns]
        self.items = [p[2] for p in patterns]
        table = np.stack([p[1] for p in patterns])
        blocks = [self._hash([table[:, j + i] for i in range(self.block)]) for j in range(length - self.block + 1)]
        bits = min(22, max(10, int(np.ceil(np.log2(16 * len(patterns) * len(blocks))))))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - self.block + 1, np.int64)
        for j, b in enumerate(blocks):
            np.minimum.at(self.shift, b >> self.down, len(blocks) - 1 - j)
        buckets = self._bucket(blocks[-1], blocks[0])
        self.order = np.argsort(buckets, kind="stable")
        self.buckets = buckets[self.order]

    @staticmethod
    def _hash(members: list[np.ndarray]) -> np.ndarray:
        return chain(members)

    @staticmethod
    def _bucket(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return chain([suffix, prefix])

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of last words of windows whose last block has shift 0."""
        n, found = len(hashes), []
        at = np.arange(0, n, LANE)
        stop = np.minimum(at + LANE, n)
        at = np.maximum(at, self.length - 1)
        while len(at := at[(live := at < stop)]):
            stop = stop[live]
            step = self.shift[self._hash([hashes[at - self.block + 1 + i] for i in range(self.block)]) >> self.down]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, w: Words, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence."""
        last = self.candidates(w.hashes)
        first = last - self.length + 1
        block = lambda at: self._hash([w.hashes[at + i] for i in range(self.block)])
        keys = self._bucket(block(last - self.block + 1), block(first))
        lo, hi = np.searchsorted(self.buckets, keys, "left"), np.searchsorted(self.buckets, keys, "right")
        for at, i, j in zip(first[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            text = None
            for k in self.order[i:j].tolist():
                text = text or [data[s:e].tobytes() for s, e in zip(w.starts[at : at + self.length].tolist(), w.ends[at : at + self.length].tolist(), strict=True)]
                if text == self.words[k]:
                    yield at, k


def scanners(items: list[tuple[object, str]], window: int) -> list[Scanner]:
    """A scanner for each pattern length among the items' windows; an item shorter than `window` is one pattern."""
    by_length: dict[int, dict[bytes, tuple[list[bytes], np.ndarray, set[str]]]] = defaultdict(dict)
    for key, text in items:
        data, offsets = strings(pa.array([text], pa.string()))
        w = words(data, offsets, MARKS)
        data = LOWER[data]
        text_words = [data[s:e].tobytes() for s, e in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
        size = min(window, len(text_words))
        for i in range(len(text_words) - size + 1 if size else 0):
            own = text_words[i : i + size]
            by_length[size].setdefault(b" ".join(own), (own, w.hashes[i : i + size], set()))[2].add(str(key))
    return [Scanner(size, list(found.values())) for size, found in sorted(by_length.items())]


_built: dict[str, list[Scanner]] = {}
#: Tables of so many blocks are kept by a worker.
_KEPT = 4
#: Bytes of text that are scanned together where there are more blocks, so that tables are built once for all of them.
_TOGETHER = 32 << 20


def _scanners_of(name: str, block, window: int) -> list[Scanner]:
    """Tables of a broadcast block of items, built once while they are kept; the items themselves are let go again."""
    if name not in _built:
        while len(_built) >= _KEPT:
            _built.pop(next(iter(_built)))
        _built[name] = scanners(block.value, window)
        block.__dict__.pop("_value", None)  # read from its file again if wanted
    return _built[name]


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        if block and size + len(row.text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item, row.text))
        size += len(row.text)
    if block:
        yield block


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str,
    window: int = 13, percent: int = 5, block_bytes: int = 8 << 20,
) -> DataFrame:
    """Per row of `docs`: id, n_words, n_hit, n_items, items, spans, contaminated.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  A
    document word is hit if it lies in an occurrence of `window` consecutive words of an
    item, or of all words of a shorter item.  `items` are the ids of those items as sorted
    strings, `spans` the hit word ranges [from, to).  A document is contaminated if it has
    hits and they are at least `percent` % of its words.

    The benchmark is the stated query set: it is streamed to the driver in blocks of at most
    `block_bytes` characters (or one longer item), each block is broadcast, and every document
    meets every block.  A worker keeps the tables of four blocks; with more, it scans 32 MB of text
    against one block after another, so any size of benchmark gives whole results within
    bounded memory.  Documents are scanned in place; nothing is shuffled.

    Null and wordless texts have no words and no hits.  Items without an id or words take no
    part; rows that repeat an item id count as one item.  Rows of `docs` are kept as they are,
    repeated ids included.  Empty tables give no rows, or no hits.
    """
    spark = docs.sparkSession
    given = own_names(docs, id=id_col, text=text_col)
    listed = own_names(benchmark, item=item_id_col, text=item_text_col).where("item is not null and text is not null")
    blocks = [(uuid.uuid4().hex, spark.sparkContext.broadcast(b)) for b in _item_blocks(listed, block_bytes)]

    def scan(texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[Iterator[tuple[int, int, set[str], list[dict]]]]:
        """For each piece of text its rows' words, hits, items and spans; the blocks take turns over all pieces."""
        parts = [(words(d, o, MARKS), LOWER[d]) for d, o in texts]
        edges = [np.zeros(len(w.hashes) + 1, np.int64) for w, _ in parts]
        items: list[dict[int, set[str]]] = [defaultdict(set) for _ in parts]
        for name, block in blocks:
            for s in _scanners_of(name, block, window):
                for (w, data), edge, own in zip(parts, edges, items, strict=True):
                    for at, k in s.search(w, data):
                        row = int(np.searchsorted(w.rows, at, "right")) - 1
                        if at + s.length <= w.rows[row + 1]:  # windows don't reach into the next row
                            edge[at] += 1
                            edge[at + s.length] -= 1
                            own[row] |= s.items[k]
        for (w, _), edge, own in zip(parts, edges, items, strict=True):
            yield found(w, np.cumsum(edge)[:-1] > 0, own)

    def found(w: Words, hit: np.ndarray, items: dict[int, set[str]]) -> Iterator[tuple[int, int, set[str], list[dict]]]:
        before = np.concatenate([[0], np.cumsum(hit)])
        for row, (lo, hi) in enumerate(zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True)):
            spans = []
            if row in items:
                turn = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].view(np.int8), [0]])))
                spans = [{"from": a, "to": b} for a, b in turn.reshape(-1, 2).tolist()]
            yield hi - lo, int(before[hi] - before[lo]), items.get(row, set()), spans

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[pa.Array, np.ndarray, np.ndarray]]]:
        """Pieces (ids, bytes, offsets) that are scanned together."""
        held, size = [], 0
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in pieces(offsets):
                held.append((batch.column(0).slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                size += int(offsets[hi] - offsets[lo])
                if len(blocks) <= _KEPT or size >= _TOGETHER:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in together(batches):
            for (ids, *_), rows in zip(held, scan([x[1:] for x in held]), strict=True):
                got = list(rows)
                n, hits = [g[0] for g in got], [g[1] for g in got]
                items = [sorted(g[2]) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                        pa.array(items, pa.list_(pa.string())), pa.array([g[3] for g in got], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                        pa.array([h > 0 and 100 * h >= percent * k for h, k in zip(hits, n, strict=True)], pa.bool_()),
                    ],
                    ["id", "n_words", "n_hit", "n_items", "items", "spans", "contaminated"],
                )

    kind = given.schema["id"].dataType.simpleString()
    return map_arrow(given, run, f"id {kind}, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<`from`:long,`to`:long>>, contaminated boolean")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `contamination`: item ids as one SHA-256."""
    return found.select("id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")

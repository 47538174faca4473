"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised (A-Z lower-cased, runs of other ASCII characters to one space). An item of
m bytes that occurs in a text with at most e edits shares at least m - q + 1 - q * e of its q-grams with it, on
diagonals (text position minus item position) that lie within e + 1 of each other. Hits are counted in overlapping
bands of diagonals, 2 (e + 1) wide and e + 1 apart, so that every such run lies in one band whole. Bands that reach
the bound are verified by banded alignment, which also yields the place and the edits; an item that stands in the band
unchanged needs no alignment. The edits are budgeted on the whole item, however long.

A band counts places of the text, so a gram that an item repeats adds one where it stands and not one for each of its
places: an item's equal grams are one entry for each e + 1 of its places. Hits are counted SLICE entries at a time, and
bands that lie behind the slice are settled, so memory grows neither with repetitive texts nor with long ones.

The benchmark travels with the tasks while its normalised size is at most ``BLOCK_BYTES``; a larger one is cut into
blocks of items of that size, each with a written pass of its own over the documents.

Defined results: null texts and items match nothing; items under LEAST bytes after normalising take no part; parts of
an item are not looked for; repeated items are reported under each of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, filter_batches, map_batches, string_bytes, table, texts

#: Production parameters: q, edits as a share of the item's bytes, shortest item, benchmark bytes in one pass, text bytes worked on at once, entries counted at once.
Q, EDITS, LEAST, BLOCK_BYTES, CHUNK, SLICE = 10, 0.08, 32, 16 << 20, 4 << 20, 1 << 20

_CLASS = np.full(256, 32, np.uint8)
_CLASS[48:58] = np.arange(48, 58)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def normalise(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, their offsets, and the place in ``raw`` of each byte kept. Every text ends in a space."""
    flat = _CLASS[raw]
    space = flat == 32
    keep = ~space
    if len(flat):
        keep[1:] |= ~space[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        keep[first] = ~space[first]  # no space in front of a text
    place = np.flatnonzero(keep)
    return flat[place], np.searchsorted(place, offsets), place


def gram_hashes(text: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q bytes from each place; equal q-grams have equal hashes."""
    n = max(len(text) - q + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(0, q, 8):
        width = min(8, q - k)
        padded = np.concatenate([text[k:], np.zeros(8, np.uint8)])
        word = np.ndarray((n,), "<u8", padded, strides=(1,)).copy()
        if width < 8:
            word &= np.uint64((1 << 8 * width) - 1)
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0xFF51AFD7ED558CCD)


def budget(m: int, q: int = Q, share: float = EDITS) -> int:
    """Edits allowed in an item of m bytes; no more than the lemma can tell."""
    return max(0, min(int(share * m), (m - q) // q))


def align(pattern: np.ndarray, text: np.ndarray, base: int, width: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the pattern's best place in text with start - base in [0, width), on diagonals base - most to base + width + most.

    Banded: row j holds the diagonals d, text position base - most + j + d; a cell is edits * K + start, so that of
    equal edits the earliest start wins.
    """
    low, size = base - most, width + 2 * most + 1
    k = np.int64(1 << 40)
    at = np.arange(size, dtype=np.int64)
    begin = low + at
    cell = np.where((begin >= 0) & (begin <= len(text)), begin + (1 << 30), 1 << 60).astype(np.int64)
    padded = np.full(len(text) + 2 * size + len(pattern), 256, np.int16)  # nothing equals 256
    shift = max(0, -low)
    padded[shift : shift + len(text)] = text
    far = np.int64(1 << 60)
    for j, c in enumerate(pattern):
        a = low + j + shift
        row = padded[a : a + size]
        if len(row) < size:
            row = np.concatenate([row, np.full(size - len(row), 256, np.int16)])
        step = cell + np.where(row == c, 0, k)
        step[row == 256] = far
        step[:-1] = np.minimum(step[:-1], cell[1:] + k)
        cell = np.minimum.accumulate(step - at * k) + at * k
    ends = low + len(pattern) + at
    cell = np.where((ends >= 0) & (ends <= len(text)), cell, far)
    best = int(cell.argmin())
    edits = int(cell[best] >> 40)
    return None if edits > most else (edits, int((cell[best] & ((1 << 40) - 1)) - (1 << 30)), int(ends[best]))


class Benchmark:
    """Patterns of one block of items, with the index of their q-grams."""

    def __init__(self, items: list[tuple[int, str | None]], q: int = Q, share: float = EDITS, least: int = LEAST):
        self.q = q
        self.pattern: list[np.ndarray] = []
        ids: list[int] = []
        for item, text in items:
            raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
            clean = normalise(raw, np.array([0, len(raw)]))[0]
            clean = clean[:-1] if len(clean) and clean[-1] == 32 else clean
            if len(clean) >= max(least, q):
                self.pattern.append(clean)
                ids.append(item)
        self.item = np.array(ids, np.int64)
        self.size = np.array([len(p) for p in self.pattern], np.int64)
        self.most = np.array([budget(m, q, share) for m in self.size.tolist()], np.int64)
        self.bound = self.size - q + 1 - q * self.most
        grams = [gram_hashes(p, q) for p in self.pattern]
        keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        # equal grams of an item within e + 1 places are one entry: the number of that stretch, and the least and largest rest
        step = (self.most + 1)[owner]
        stretch, rest = place // np.maximum(step, 1), place % np.maximum(step, 1)
        order = np.lexsort((rest, stretch, owner, keys))
        keys, owner, stretch, rest = keys[order], owner[order], stretch[order], rest[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]) | (stretch[1:] != stretch[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(keys)) - 1 if len(at) else at
        self.owner, self.stretch, self.low, self.high = owner[at], stretch[at], rest[at], rest[last]
        self.keys, first = np.unique(keys[at], return_index=True)
        self.first = np.append(first, len(at))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, text: np.ndarray, off: np.ndarray, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, rows of their grams in the index) of the q-grams that lie inside a text and that an item has too."""
        for a in range(0, len(text), chunk):
            h = gram_hashes(text[a : a + chunk + self.q - 1], self.q)
            at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            row = np.searchsorted(self.keys, h[at]).clip(max=len(self.keys) - 1)
            hit = self.keys[row] == h[at]
            at, row = at[hit] + a, row[hit]
            whole = at + self.q <= off[np.searchsorted(off, at, side="right")]
            yield at[whole], row[whole]

    def bands(self, text: np.ndarray, off: np.ndarray, chunk: int, slice_: int = SLICE) -> Iterator[np.ndarray]:
        """Rows (text, pattern, band) that reach their bounds, about ``slice_`` entries at a time."""
        held, count = np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
        for at, row in self.hits(text, off, chunk):
            n = self.first[row + 1] - self.first[row]
            cuts = [0]
            while cuts[-1] < len(at):
                done = int(n[: cuts[-1]].sum())
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(np.cumsum(n), done + slice_, side="right"))))
            for x, z in zip(cuts, cuts[1:]):
                many = n[x:z]
                entry = np.repeat(self.first[row[x:z]], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                p = self.owner[entry]
                place = np.repeat(at[x:z], many)
                doc = np.searchsorted(off, place, side="right") - 1
                step = self.most[p] + 1
                whole, rest = place // step, place % step
                band = whole - self.stretch[entry]
                # diagonals of the stretch lie in its band where the rest is small, and in the one before where it is large
                here, before = self.low[entry] <= rest, self.high[entry] > rest
                rows = [np.stack([place, doc, p, b])[:, ok] for b, ok in ((band, here), (band - 1, before))]
                rows = np.concatenate([*rows, *(r - np.array([[0], [0], [0], [1]]) for r in rows)], axis=1)  # bands overlap by half
                rows = rows[:, np.lexsort(rows)]
                new = np.ones(rows.shape[1], bool)
                new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
                held = np.concatenate([held, rows[1:, new]], axis=1)
                count = np.concatenate([count, np.ones(held.shape[1] - len(count), np.int64)])
                order = np.lexsort(held[::-1])
                held, count = held[:, order], count[order]
                first = np.ones(held.shape[1], bool)
                first[1:] = (held[:, 1:] != held[:, :-1]).any(axis=0)
                first = np.flatnonzero(first)
                held, count = held[:, first], np.add.reduceat(count, first) if len(first) else count
                reach = (held[2] + 2) * (self.most[held[1]] + 1) + self.size[held[1]]
                settled = (reach <= at[z - 1]) | (held[0] < doc[-1])
                yield held[:, settled & (count >= self.bound[held[1]])].T
                held, count = held[:, ~settled], count[~settled]
        yield held[:, count >= self.bound[held[1]]].T

    def find(self, raw: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, start, end, edits) of every occurrence, in bytes of the text as it is."""
        if not len(self.keys):
            return
        text, off, origin = normalise(raw, offsets)
        data = text.tobytes()
        seen = set()
        for found in self.bands(text, off, chunk):
            for d, p, b in found.tolist():
                a, z, most, size = int(off[d]), int(off[d + 1]), int(self.most[p]), int(self.size[p])
                low = b * (most + 1)
                lo, hi = max(a, low - most), min(z, low + 2 * (most + 1) + size + most)
                s = data.find(self.pattern[p].tobytes(), lo, hi)
                e = s + size
                edits = 0
                if s < 0:
                    best = align(self.pattern[p], text[lo:hi], low - lo, 2 * (most + 1), most)
                    if best is None:
                        continue
                    edits, s, e = best[0], lo + best[1], lo + best[2]
                key = (d, p, s, e)
                if key not in seen and e > s:
                    seen.add(key)
                    yield d, int(self.item[p]), int(origin[s] - offsets[d]), int(origin[e - 1] + 1 - offsets[d]), edits


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items, in blocks of about ``block_bytes``, and whether a block is the last; the size is measured first."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [tuple(r) for r in own.orderBy("item_id", "text").collect()], k == blocks - 1


def _search(index: Benchmark, batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item id, start, end, edits) of a batch's texts, some CHUNK bytes at a time."""
    raw, offsets = string_bytes(batch.column("text"))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        for d, *rest in index.find(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
            yield (a + d, *rest)
        a = b


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDITS, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the text) and edits, a row for each occurrence of a benchmark item."""

    def search(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Benchmark(block, q, share, least)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[d], *rest) for d, *rest in _search(index, batch)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.int32()])], names=["doc_id", "item_id", "start", "end", "edits"])

        return map_batches(texts(docs), run, "doc_id long, item_id long, start long, end long, edits int")

    found, scratch = [], Scratch(docs.sparkSession)
    for block, last in _blocks(benchmark, block_bytes):  # one block at a time is on the driver
        found.append(search(block) if last and not found else scratch.save(search(block)))
    return reduce(DataFrame.unionAll, found)


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDITS, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, whole rows, in which no benchmark item occurs."""

    def clean(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        def keep():
            index = Benchmark(block, q, share, least)

            def good(batch: pa.RecordBatch) -> np.ndarray:
                out = np.ones(batch.num_rows, bool)
                out[[d for d, *_ in _search(index, batch)]] = False
                return out

            return good

        return filter_batches(docs, keep)

    scratch = Scratch(docs.sparkSession)
    for block, last in _blocks(benchmark, block_bytes):
        docs = clean(docs, block) if last else scratch.save(clean(docs, block))
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

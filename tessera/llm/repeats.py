"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere are removed.

Every start x of such a string belongs to its minimiser, the least hash of the GRAM-byte strings inside
[x, x + length), the first of equal ones. Neighbouring starts with one minimiser, on one side of the middle, share a
core: the bytes around the minimiser that all their strings hold, over half of ``length``. They travel as one window of
text, and the hash of the core is its key. Equal strings have equal cores at equal places, so all repeats of a string
meet under one key, each start stands in exactly one window, and no window holds a string twice. Keys that stand once
in the corpus hold no repeat and go no further: only hashes have been shuffled by then. Equal windows (by a 128-bit
hash of their bytes) are counted before the shuffle: they repeat each other whole, and travel once, with their number,
if other windows have the same key.

The different windows of a key are sorted in a shard: shards are cut between keys at about SHARD_BYTES, their windows
are concatenated and suffix-sorted by external induction (``suffixarray``), and the common prefixes tell which starts
share ``length`` bytes. A key with more than WINDOWS different windows (a passage that very many texts surround) is
dealt anew by narrower cores: its windows are cut into fewer starts, whose strings share more bytes, until the keys
fit. Starts alone in their windows need no sorting, so that ends, no key is hot, and nothing is dropped.

Two lengths are looked for in one pass: the strings to remove, and shorter ones, of which the passages of over
PASSAGE_WORDS words that stand elsewhere too are made up (many of those are shorter than ``length``; they are counted
and stay). Minimisers and cores are those of the shorter strings, and a window's text reaches as far as the longer ones.

Defined results: strings are judged on UTF-8 bytes of the input; null texts are empty; matches never cross texts;
texts shorter than ``length`` lose nothing; a row that repeats another (same id and text) is one more copy of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, groups, map_batches, string_bytes, table, texts
from tessera.llm.suffixarray import Sorter

#: Production parameters: bytes of a repeated string, bytes hashed for minimisers, different windows of a key in one shard, starts of a window when a key is dealt anew, bytes of a shard, bytes of a sorter's queue in memory, bytes worked on at once.
LENGTH, GRAM, WINDOWS, FINER, SHARD_BYTES, MEMORY, PIECE = 400, 32, 512, (21, 3, 1), 4 << 20, 4 << 20, 1 << 20
#: Production parameters of passages: bytes of the strings that they are made up of, and the words that they have more than.
PASSAGE, PASSAGE_WORDS = 300, 50

#: Low bits of a packed minimiser: its place in the piece.
_PLACE = np.uint64((1 << 21) - 1)
_SYMBOL = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, as far as a piece reaches."""
    out = []
    for b in (_ODD, pow(_ODD, -1, 1 << 64)):
        x = np.full(1 << 21, np.uint64(b))
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return tuple(out)


def rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from each place. They only order the strings; no result rests on their being different."""
    power, inverse = _powers()
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SYMBOL[raw] * power[: len(raw)], out=sums[1:])
    h = sums[size:] - sums[: len(raw) - size + 1]
    h *= inverse[: len(h)]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from blocks of that width scanned from both ends."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def pieces_of(offsets: np.ndarray, length: int, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, text bounds in between) of the pieces to work on: texts in a row, or a part of a long one; parts overlap by length - 1 bytes."""
    d, n = 0, len(offsets) - 1
    while d < n:
        a, z = int(offsets[d]), int(offsets[d + 1])
        if z - a > piece:
            for low in range(a, z - length + 1, piece):
                end = min(z, low + piece + length - 1)
                yield low, end, np.array([low, end])
            d += 1
            continue
        e = max(d + 1, int(np.searchsorted(offsets, a + piece, side="right")) - 1)
        yield a, int(offsets[e]), offsets[d : e + 1]
        d = e


def windows(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, number of starts, minimiser's place) of the windows of all texts, by places in raw, piece by piece."""
    half = (length - gram + 1) // 2
    for low, end, bounds in pieces_of(offsets, length, piece):
        part = raw[low:end]
        if len(part) < length:
            continue
        least = rolling(part, gram)
        least &= ~_PLACE
        least |= np.arange(len(least), dtype=np.uint64)
        least = window_minima(least, length - gram + 1)
        cut = np.zeros(len(least) + 1, bool)
        cut[0] = True
        cut[1:-1] = least[1:] != least[:-1]
        begin, last = bounds[:-1] - low, bounds[1:] - low - length + 1  # the first start that a text has no room for
        fit = last > begin
        cut[begin[fit]] = True
        cut[last[fit]] = True
        first = np.flatnonzero(cut[:-1])
        text = np.searchsorted(bounds, first + low, side="right") - 1
        inside = first < last[text]
        n = np.diff(np.append(first, len(least)))[inside]
        first = first[inside]
        place = (least[first] & _PLACE).astype(np.int64)
        middle = np.clip(place - half + 1, first, first + n)
        a = np.concatenate([first, middle])
        n = np.concatenate([middle - first, first + n - middle])
        place = np.concatenate([place, place])
        some = n > 0
        yield a[some] + low, n[some], place[some] + low


def window_keys(data: memoryview, a: np.ndarray, n: np.ndarray, size: np.ndarray, place: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the windows' cores, and of their ``size`` bytes and ``n`` starts (two columns)."""
    half = (length - gram + 1) // 2
    left = place - a >= half
    low = np.where(left, place - half, place)
    high = np.where(left, place + gram, place + length - half + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(data[x:y], s) for x, y, s in zip(low.tolist(), high.tolist(), left.tolist())), np.uint64, len(a))
    return h.view(np.int64), _content(data, a, n, size)


def _content(data: memoryview, a: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
    digests = b"".join([xxhash.xxh3_128_digest(data[x : x + k], m) for x, k, m in zip(a.tolist(), size.tolist(), n.tolist())])
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def mark_shard(parts: list[tuple[int, int, bytes]], lengths: tuple[int, ...] = (LENGTH,), memory: int = MEMORY) -> list[list[tuple[int, int, int]]]:
    """For windows (copies, starts, text), (length, from, to) of the spans that repeated strings of each length cover, by the suffix array.

    Only a window's first ``starts`` places count: what follows is the text of other windows, which hold it as their own.
    """
    sizes = np.array([len(b) for *_, b in parts], np.int64)
    at = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(int(sizes.sum()) + len(parts) + 1, np.uint16)  # 1 ends a window, 0 the shard
    text[-1] = 0
    for (*_, b), a in zip(parts, at.tolist()):
        text[a : a + len(b)] = np.frombuffer(b, np.uint8).astype(np.uint16) + 2
    order, prefix = Sorter(text, max(lengths), memory).sort()
    copies, starts = (np.array([p[k] for p in parts], np.int64) for k in (0, 1))
    out: list[list[tuple[int, int, int]]] = [[(n, 0, len(b)) for n in lengths if len(b) >= n] if c > 1 else [] for c, _, b in parts]
    for length in lengths:
        # how often each window's own places stand in all, over neighbours in order that share the length
        n = np.maximum(np.minimum(starts, sizes - length + 1), 0)
        place = np.repeat(at, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(np.arange(len(parts)), n)
        weight = np.zeros(len(text), np.uint8)
        weight[place] = np.minimum(copies[owner], 2)
        new = np.flatnonzero(prefix < length)
        total = np.add.reduceat(weight[order], new, dtype=np.int64)
        many = np.zeros(len(text), bool)
        many[order] = np.repeat(total > 1, np.diff(np.append(new, len(order))))
        hit = many[place] & (copies[owner] == 1)
        place, owner = place[hit], owner[hit]
        if len(place):
            new = np.concatenate([[True], (np.diff(place) > length) | (np.diff(owner) > 0)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place)) - 1
            for k, a, b in zip(owner[first].tolist(), place[first].tolist(), place[last].tolist()):
                out[k].append((length, a - int(at[k]), b - int(at[k]) + length))
    return out


_WINDOW = "h long, w1 long, w2 long"


def _sorted_marks(pieces: DataFrame, lengths: tuple[int, ...], shard_bytes: int = SHARD_BYTES, memory: int = MEMORY) -> DataFrame:
    """(h, w1, w2, length, from, to): the repeated spans of windows (h, w1, w2, c, n, window), which are different ones of their keys."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, int, bytes]] = []

        def out() -> pa.RecordBatch:
            spans = mark_shard([x[3:] for x in held], lengths, memory)
            rows = [(*x[:3], *s) for x, own in zip(held, spans) for s in own]
            cols = [*zip(*rows)] or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64()] * 3 + [pa.int32()] * 3)], names=["h", "w1", "w2", "length", "from", "to"])

        size = 0
        for g in groups(batches, ["h"]):
            rows = {key[:3]: key for key in zip(*(g[c].tolist() for c in ("h", "w1", "w2", "c", "n")), g["window"])}  # a document that repeats sends its windows again
            held += rows.values()
            size += sum(len(b) for *_, b in rows.values())
            if size >= shard_bytes:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return map_batches(pieces.select("h", "w1", "w2", "c", "n", "window").repartition("h").sortWithinPartitions("h"), mark, f"{_WINDOW}, length int, `from` int, `to` int")


def _whole(kinds: DataFrame, size, lengths: tuple[int, ...]) -> DataFrame:
    """Marks of windows that stand more than once: they repeat each other from end to end, for every length that they have room for."""
    each = kinds.filter("c > 1").select("h", "w1", "w2", F.explode(F.array(*map(F.lit, lengths))).alias("length"), F.lit(0).alias("from"), size.cast("int").alias("to"))
    return each.filter(F.col("to") >= F.col("length"))


def _finer(hot: DataFrame, starts: int, length: int, reach: int) -> DataFrame:
    """Windows cut into those of ``starts`` starts, by the starts' distance from the minimiser; r1, r2, r3 and shift tell where they come from."""
    names = ["h", "w1", "w2", "c", "lead", "n", "window", "r1", "r2", "r3", "shift"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = memoryview(row["window"])
                last = row["n"] - 1  # of the starts, from 0
                lead = row["lead"]  # distance of the first start from the minimiser
                parts = range((lead - last) // starts, lead // starts + 1)
                first = np.array([max(0, lead - (b * starts + starts - 1)) for b in parts], np.int64)
                n = np.array([min(last, lead - b * starts) for b in parts], np.int64) - first + 1
                # the core: bytes that the strings of all starts of the part hold, were they all there
                low = np.array([lead - b * starts for b in parts], np.int64)
                size = length - starts + 1
                core = [xxhash.xxh64_intdigest(data[max(0, x) : x + size], b % (1 << 32)) for x, b in zip(low.tolist(), parts)]
                wide = np.minimum(n - 1 + reach, len(data) - first)
                w = _content(data, first, n, wide)
                k = len(core)
                columns = [pa.array(np.array(core, np.uint64).view(np.int64)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), pa.array([row["c"]] * k, pa.int64()), pa.array(lead - first, pa.int64()), pa.array(n, pa.int64())]
                columns += [pa.array([bytes(data[x : x + m]) for x, m in zip(first.tolist(), wide.tolist())], pa.binary()), *(pa.array([row[c]] * k, pa.int64()) for c in ("r1", "r2", "r3")), pa.array((row["shift"] + first).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(hot.select(*names), run, f"{_WINDOW}, c long, lead long, n long, window binary, r1 long, r2 long, r3 long, shift int")


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM, limit: int = WINDOWS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, th (hash of the text) and spans of repeated bytes array<struct<length, a, b>>, not merged; rows without one are left out. lengths: ascending."""
    scratch = scratch or Scratch(docs.sparkSession)
    length, reach = lengths[0], lengths[-1]
    # a missing id is one more id; text and id tell the rows apart
    own = texts(docs).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    window = ["h", "w1", "w2"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_bytes(batch.column("text"))
            data = memoryview(np.ascontiguousarray(raw))
            ids, hashes = batch.column("doc_id"), batch.column("th").to_numpy()
            for a, n, place in windows(raw, offsets, length, gram):
                d = np.searchsorted(offsets, a, side="right") - 1
                size = np.minimum(n - 1 + reach, offsets[d + 1] - a)
                h, w = window_keys(data, a, n, size, place, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), ids.take(pa.array(d)), pa.array(hashes[d]), *(pa.array(x.astype(np.int32)) for x in (a - offsets[d], n, size, place - a))],
                    names=[*window, "doc_id", "th", "a", "n", "size", "lead"],
                )

    runs = scratch.save(map_batches(own, scan, f"{_WINDOW}, doc_id long, th long, a int, n int, size int, lead int"))
    hot = scratch.save(runs.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h"))
    alive = scratch.save(runs.join(hot, "h", "left_semi"))
    scratch.drop(runs, hot)
    # equal windows repeat each other whole; one occurrence stands for them where there are others under the key
    kinds = scratch.save(alive.groupBy(*window).agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "a", "n", "size", "lead")).alias("f")))
    many = scratch.save(kinds.groupBy("h").agg(F.count("*").alias("d")).filter("d > 1"))
    sent = kinds.join(many, "h").select("f.doc_id", "f.th", F.struct(*window, "c", "d", "f.a", "f.n", "f.size", "f.lead").alias("s"))
    wanted = scratch.save(sent.groupBy("doc_id", "th").agg(F.collect_list("s").alias("s")))
    names = [*window, "c", "d", "lead", "n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("s").to_pylist()):
                data = (text or "").encode("utf-8", "replace")
                cols = [[p[c] for p in parts] for c in names]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array([data[p["a"] : p["a"] + p["size"]] for p in parts], pa.binary())], names=[*names, "window"])

    # null-safe on the id
    same = (F.col("o.doc_id").eqNullSafe(F.col("m.doc_id"))) & (F.col("o.th") == F.col("m.th"))
    found = own.alias("o").join(wanted.alias("m"), same).select("o.text", "m.s")
    pieces = scratch.save(map_batches(found, cut, f"{_WINDOW}, c long, d long, lead long, n long, window binary"))
    scratch.drop(wanted, many)
    marks = [_whole(kinds, F.col("f.size"), lengths), scratch.save(_sorted_marks(pieces.filter(F.col("d") <= limit), lengths))]
    hot = pieces.filter(F.col("d") > limit).select(*window, "c", "lead", "n", "window", F.col("h").alias("r1"), F.col("w1").alias("r2"), F.col("w2").alias("r3"), F.lit(0).alias("shift")).dropDuplicates(window)
    for starts in FINER:
        if hot.isEmpty():
            break
        parts = scratch.save(_finer(hot, starts, length, reach))
        kinds = scratch.save(parts.groupBy(*window).agg(F.sum("c").alias("c"), F.first("n").alias("n"), F.first("window").alias("window")))
        many = scratch.save(kinds.groupBy("h").agg(F.count("*").alias("d")).filter("d > 1"))
        found = _whole(kinds, F.length("window"), lengths)
        if starts > 1:
            fits = F.col("d") <= limit
            found = found.union(_sorted_marks(kinds.join(many.filter(fits), "h"), lengths))
            hot = parts.join(many.filter(~fits), "h", "left_semi")
        else:  # one start: its shortest string is the core, which the windows of a key share
            found = found.union(kinds.join(many, "h").select(*window, F.lit(length).alias("length"), F.lit(0).alias("from"), F.lit(length).alias("to")))
        found = scratch.save(found)
        back = parts.join(found, window).select(F.col("r1").alias("h"), F.col("r2").alias("w1"), F.col("r3").alias("w2"), "length", (F.col("from") + F.col("shift")).alias("from"), (F.col("to") + F.col("shift")).alias("to"))
        marks.append(scratch.save(back))
    scratch.drop(pieces)  # what is left of them are marks
    spans = alive.select(*window, "doc_id", "th", "a").join(reduce(DataFrame.unionAll, marks), window).select("doc_id", "th", F.struct("length", (F.col("a") + F.col("from")).alias("a"), (F.col("a") + F.col("to")).alias("b")).alias("s"))
    return spans.groupBy("doc_id", "th").agg(F.collect_list("s").alias("spans"))


def merge(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, from the starts and ends of spans; touching spans are one run."""
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[first].tolist(), b[np.append(first[1:], len(b)) - 1].tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, digest: bool = False, limit: int = WINDOWS, passage: int = PASSAGE, words: int = PASSAGE_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, either (spans, kept) or kept_sha256, and n_passages. kept is binary: a removed run may cut a character.

    n_passages: maximal runs covered by strings of ``passage`` bytes that also start elsewhere and with over ``words`` words.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    passage = min(passage, length)
    spans = scratch.save(repeated_spans(docs, tuple(sorted({passage, length})), limit=limit, scratch=scratch))
    own = texts(docs).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (F.col("o.doc_id").eqNullSafe(F.col("m.doc_id"))) & (F.col("o.th") == F.col("m.th"))
    joined = own.alias("o").join(spans.alias("m"), same, "left").select("o.doc_id", "o.text", "m.spans")
    last = [("kept_sha256", pa.string())] if digest else [("spans", pa.list_(pa.list_(pa.int32()))), ("kept", pa.binary())]
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), *last, ("n_passages", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spans = batch.column("spans")
            flat = spans.flatten()
            size, start, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("length", "a", "b"))
            cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))]).tolist()
            for i, text, x, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), cuts, cuts[1:]):
                data = (text or "").encode("utf-8", "replace")
                of = lambda n: merge(start[x:y][size[x:y] == n], end[x:y][size[x:y] == n])  # noqa: B023, E731
                runs = of(length)
                many = sum(len(data[a:b].split()) > words for a, b in of(passage))
                kept = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(data)]))
                rows.append((i, len(data), len(data) - len(kept), len(runs), *([hashlib.sha256(kept).hexdigest()] if digest else [[[*r] for r in runs], kept]), many))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "spans array<array<int>>, kept binary") + ", n_passages long")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)

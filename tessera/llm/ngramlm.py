"""LM scoring: deleted interpolation of n-gram maximum-likelihood estimates, up to trigrams.

Counts cover every training document. Texts are packed into blocks of documents; a block hashes its words and n-grams,
sums them, and sends one sorted array of (key, count) to each of a number of key ranges. A range is a task of its own,
adds up the counts of its keys over all blocks and answers every block with the totals of the keys that it asked for.
So a key is shuffled once per block and not once per position, and no table of counts is ever collected or broadcast.
With the answers a block knows the counts of all its positions. Words have keys of 64 bits; n-grams have as many bytes
as leave less than one key in 2^17 to share its hash with another, whatever the size of the corpus (``gram_bytes``).

The mixture weights of the orders depend on the frequency bucket (base-2 logarithm) of the longest context that has
been seen. They are learned by expectation-maximisation on held-out counts: each training position is held out in
turn, its own occurrence being deleted from all counts. The positions enter EM as a histogram over context bucket and
the logarithms of the three held-out estimates, which has a fixed size.

Defined results: null and empty texts hold the end token alone; an n-gram of unknown words falls back to
the uniform share 1 / (V + 1), so scores are finite; without training tokens the uniform share is all there is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, deal, groups, map_batches, string_bytes, table, texts

#: Production parameters. BLOCK_BYTES and BLOCK_TEXTS bound a block's texts (a longer text is a block of its own), PART_BYTES is the text for which there is a key range.
BLOCK_BYTES, BLOCK_TEXTS, PART_BYTES, BUCKETS, BINS, ROUNDS, FOLDS, HELD_OUT = 4 << 20, 16_384, 12 << 20, 16, 32, 50, 5, 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
END = np.uint64(0x1D)  # key of the end token and of the context before the first word


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the tokens of all texts, end tokens included, and the number of tokens of each text."""
    n_docs = len(offsets) - 1
    raw = _LOWER[raw]
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a word never crosses texts
    before = np.concatenate([[False], word])
    starts = np.flatnonzero(word & (~before[:-1] | edge[:-1]))
    after = np.concatenate([word, [False]])
    ends = np.flatnonzero(word & (~after[1:] | edge[1:])) + 1
    step = 1 << 20
    sums = np.zeros(len(raw) + 1, np.uint64)
    if len(raw):
        power = _powers(_BASE, min(step, len(raw)))
        shift = np.uint64(pow(int(_BASE), step, 1 << 64))
        scale = np.uint64(1)
        for a in range(0, len(raw), step):
            part = raw[a : a + step]
            sums[a + 1 : a + 1 + len(part)] = sums[a] + np.cumsum(_MIX[part] * power[: len(part)], dtype=np.uint64) * scale
            scale = np.uint64(int(scale) * int(shift) & ((1 << 64) - 1))
    h = np.zeros(len(starts), np.uint64)
    if len(starts):
        low, high = _powers(_INVERSE, 1 << 16), _powers(np.uint64(pow(int(_INVERSE), 1 << 16, 1 << 64)), (len(raw) >> 16) + 1)
        h = _finish((sums[ends] - sums[starts]) * low[starts & 0xFFFF] * high[starts >> 16] + (ends - starts).astype(np.uint64))
        h[h == END] += np.uint64(1)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    sizes = np.bincount(owner, minlength=n_docs)[:n_docs] + 1
    at = np.cumsum(sizes)
    out = np.full(int(at[-1]) if n_docs else 0, END)
    place = np.ones(len(out), bool)
    place[at - 1] = False
    out[place] = h
    return out, sizes


def contexts(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The key before each token; the end token's before the first."""
    out = np.empty_like(keys)
    out[1:] = keys[:-1]
    if len(out):
        out[np.cumsum(sizes) - sizes] = END
    return out


def joined_keys(context: np.ndarray, keys: np.ndarray, order: int) -> np.ndarray:
    """Keys of n-grams, from those of their contexts and their last words."""
    return _finish(context * np.uint64(0xD6E8FEB86659FD93) + keys + np.uint64(order))


def gram_bytes(positions: int) -> int:
    """Bytes of an n-gram's key: 17 bits more than the number of positions has, 5 to 8 bytes."""
    return min(8, max(5, -(-(max(positions, 1).bit_length() + 17) // 8)))


def in_training(ids: np.ndarray, folds: int = FOLDS, fold: int = HELD_OUT) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % folds != fold if i is not None else True for i in ids], bool)


class Block:
    """Keys of a block's positions: words, and pairs and triples (n-grams)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, train: np.ndarray, width: int):
        self.keys, self.sizes = tokens(raw, offsets)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(train, self.sizes)
        self.width = width
        before = contexts(self.keys, self.sizes)
        pairs = joined_keys(before, self.keys, 2)
        context = np.empty_like(pairs)
        context[1:] = pairs[:-1]
        context[self.first] = END
        cut = np.uint64(8 * (8 - width))
        self.grams = np.concatenate([pairs, joined_keys(context, self.keys, 3)]) >> cut

    def asked(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For words and for n-grams: sorted keys, their counts in the block's training texts, and the row of each position."""
        out = []
        for keys, train in ((self.keys, self.train), (self.grams, np.concatenate([self.train, self.train]))):
            found, inverse = np.unique(keys, return_inverse=True)
            out.append((found, np.bincount(inverse[train], minlength=len(found)), inverse))
        return out


def pack(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks (block, ids, sizes, text): texts are packed task by task, compressed, and written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        ids, sizes, parts, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            blob = pa.compress(b"".join(parts), codec="zstd", asbytes=True)
            row = [[uuid.uuid4().int >> 65], [ids], [np.array(sizes, np.int64).tobytes()], [blob], [held]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.list_(pa.int64())), *(pa.array(x, pa.binary()) for x in row[2:4]), pa.array(row[4], pa.int64())], names=["block", "ids", "sizes", "texts", "n_bytes"])

        for batch in batches:
            raw, offsets = string_bytes(batch.column("text"))
            for k, i in enumerate(batch.column("doc_id").to_pylist()):
                ids.append(i)
                sizes.append(int(offsets[k + 1] - offsets[k]))
                parts.append(raw[offsets[k] : offsets[k + 1]].tobytes())
                held += sizes[-1]
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_TEXTS:
                    yield out()
                    ids, sizes, parts, held = [], [], [], 0
        if ids:
            yield out()

    return scratch.save(map_batches(texts(docs), run, "block long, ids array<long>, sizes binary, texts binary, n_bytes long"))


def _open(batch: pa.RecordBatch, k: int, width: int) -> tuple[list, Block]:
    ids = batch.column("ids")[k].as_py()
    sizes = np.frombuffer(batch.column("sizes")[k].as_py(), np.int64)
    size = batch.column("n_bytes")[k].as_py()
    raw = np.frombuffer(pa.decompress(batch.column("texts")[k].as_py(), size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return ids, Block(raw, np.concatenate([[0], np.cumsum(sizes)]), in_training(ids), width)


def _small(x: np.ndarray) -> bytes:
    """An integer array, as narrow as it can be, compressed."""
    kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) <= np.iinfo(t).max)
    return kind[-1].encode() + len(x).to_bytes(8, "little") + pa.compress(x.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _large(b: bytes) -> np.ndarray:
    n, kind = int.from_bytes(b[1:9], "little"), f"<u{b[:1].decode()}"
    return np.frombuffer(pa.decompress(b[9:], n * int(kind[-1]), codec="zstd", asbytes=True), kind).astype(np.int64) if n else np.zeros(0, np.int64)


def _pack_keys(keys: np.ndarray, width: int) -> bytes:
    """Sorted keys as differences: their bytes in planes, so that the upper ones, nearly all zero, compress away."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(keys).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack_keys(b: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.zeros((n, 8), np.uint8)
    if n:
        planes[:, :width] = np.frombuffer(pa.decompress(b[8:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return np.cumsum(planes.view(np.uint64).ravel(), dtype=np.uint64)


class Totals:
    """Counts of keys, added up from many sorted arrays."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.pending.append((keys, n))
        if sum(len(k) for k, _ in self.pending) > max(1 << 20, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys, n = (np.concatenate(x) for x in zip((self.keys, self.n), *self.pending))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.keys, self.n, self.pending = keys[first], np.add.reduceat(n, first) if len(first) else n, []

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.n[np.searchsorted(self.keys, keys)]


_ASK = "part int, block long, words binary, n_words binary, grams binary, n_grams binary"
_ANSWER = "block long, part int, words binary, grams binary, total long, distinct long"


def counts(blocks: DataFrame, partitions: int, width: int, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """Answers (block, part, total counts of the block's words and n-grams of that part in key order), N and V of the training words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, kinds = batch.column("block")[k].as_py(), []
                for (keys, n, _), bits in zip(_open(batch, k, width)[1].asked(), (8, width)):
                    cuts = [0, *np.searchsorted(keys, _bounds(partitions, bits)).tolist(), len(keys)]
                    kinds.append([(_pack_keys(keys[a:b], bits), _small(n[a:b])) for a, b in zip(cuts, cuts[1:])])
                columns = [range(partitions), [name] * partitions, *(x for kind in kinds for x in zip(*kind))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=[x.split()[0] for x in _ASK.split(", ")])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a range's keys are summed first and answered then, so its rows, compressed, are held meanwhile
        for rows in groups(batches, ["part"]):
            totals = []
            for kind, bits in (("words", 8), ("grams", width)):
                total = Totals()
                for keys, n in zip(rows[kind], rows[f"n_{kind}"]):
                    total.add(_unpack_keys(keys, bits), _large(n))
                total.merge()
                totals.append(total)
            n_words, v_words = int(totals[0].n.sum()), int((totals[0].n > 0).sum())
            for k in range(len(rows["part"])):
                told = [_small(t.of(_unpack_keys(rows[kind][k], bits))) for t, kind, bits in zip(totals, ("words", "grams"), (8, width))]
                yield pa.RecordBatch.from_arrays([pa.array([rows["block"][k]], pa.int64()), pa.array([rows["part"][k]], pa.int32()), *(pa.array([x], pa.binary()) for x in told), pa.array([n_words if k == 0 else 0], pa.int64()), pa.array([v_words if k == 0 else 0], pa.int64())], names=[x.split()[0] for x in _ANSWER.split(", ")])

    asked = map_batches(blocks, ask, _ASK)
    answers = scratch.save(map_batches(deal(asked, "part", partitions), answer, _ANSWER))
    total = answers.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    return answers, int(total["n"] or 0), int(total["v"] or 0)


def _bounds(partitions: int, width: int) -> np.ndarray:
    """Upper ends of equal ranges of keys of that many bytes, but the last."""
    return np.array([(k << 8 * width) // partitions for k in range(1, partitions)], np.uint64)


class Counts:
    """Counts of each position: its word, pair and triple, and the contexts of the pair and of the triple."""

    def __init__(self, block: Block, words: np.ndarray, grams: np.ndarray):
        (_, _, of_word), (_, _, of_gram) = block.asked()
        size, first = len(block.keys), block.first
        self.word, self.pair, self.triple = words[of_word], grams[of_gram[:size]], grams[of_gram[size:]]
        texts = self.word[np.cumsum(block.sizes) - 1]  # the end token's count: as many texts begin as end
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[first] = texts
        self.before2 = np.empty_like(self.word)
        self.before2[1:] = self.pair[:-1]
        self.before2[first] = texts


def _log_bin(p: np.ndarray, bins: int) -> np.ndarray:
    """0 for no chance; else 1 to bins - 1 on a logarithmic scale from 1e-12 to 1."""
    at = np.ceil((np.log10(np.maximum(p, 1e-12)) + 12) / 12 * (bins - 2)).astype(np.int64) + 1
    return np.where(p > 0, np.clip(at, 1, bins - 1), 0)


def _bin_value(bins: int) -> np.ndarray:
    out = 10.0 ** ((np.arange(bins) - 1) / (bins - 2) * 12 - 12)
    out[0] = 0
    return out


def learn(cells: np.ndarray, mass: np.ndarray, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket, [triple, pair, word, uniform]) by EM over a histogram: cells (bucket, triple bin, pair bin, word bin) and their positions."""
    value = _bin_value(BINS)
    p = np.concatenate([value[cells[:, 1:]], np.full((len(cells), 1), uniform)], axis=1)
    out = np.tile([0.25, 0.25, 0.4, 0.1], (2 * BUCKETS, 1))
    for _ in range(rounds):
        joint = out[cells[:, 0]] * p
        share = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300) * mass[:, None]
        total = np.stack([np.bincount(cells[:, 0], weights=share[:, k], minlength=2 * BUCKETS) for k in range(4)], axis=1)
        out = np.where(total.sum(axis=1, keepdims=True) > 0, (total + 1e-3) / (total + 1e-3).sum(axis=1, keepdims=True), out)
    return out


def bucket(before: np.ndarray, before2: np.ndarray) -> np.ndarray:
    """By the count of the two words before or, if they have not been seen together, of the one before."""
    low = lambda n: np.minimum(np.log2(np.maximum(n, 0) + 1).astype(np.int64), BUCKETS - 1)
    return np.where(before2 > 0, BUCKETS + low(before2), low(before))


def score(docs: DataFrame, partitions: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    blocks = pack(docs, scratch)
    size = int(blocks.agg(F.sum("n_bytes")).first()[0] or 0)
    if partitions is None:
        partitions = max(12, -(-size // PART_BYTES))
    width = gram_bytes(size)
    answers, total, distinct = counts(blocks, partitions, width, scratch)
    uniform = 1.0 / (distinct + 1)
    replies = answers.select("block", "part", "words", "grams")
    both = blocks.select("block", F.lit(-1).alias("part"), "ids", "sizes", "texts", "n_bytes")
    both = both.unionByName(replies, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "part")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Block, Counts]]:
        """Each block with the counts of its positions; its text row comes before its answers."""
        ids, block, told = None, None, []

        def done() -> tuple[list, Block, Counts]:
            return ids, block, Counts(block, *(np.concatenate([np.zeros(0, np.int64), *(_large(x[k]) for x in told)]) for k in (0, 1)))

        for batch in batches:
            for k, p in enumerate(batch.column("part").to_pylist()):
                if p == -1:
                    if block is not None:
                        yield done()
                    (ids, block), told = _open(batch, k, width), []
                else:
                    told.append((batch.column("words")[k].as_py(), batch.column("grams")[k].as_py()))
        if block is not None:
            yield done()

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * BUCKETS * BINS**3, np.int64)
        for _, block, c in opened(batches):
            t = block.train
            before, before2 = c.before[t] - 1, c.before2[t] - 1
            cell = bucket(before, before2)
            for n, context in ((c.triple, before2), (c.pair, before), (c.word, np.full(int(t.sum()), total - 1))):
                cell = cell * BINS + _log_bin(np.where(context > 0, (n[t] - 1) / np.maximum(context, 1), 0.0), BINS)
            out += np.bincount(cell, minlength=len(out))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at], pa.int64())], names=["cell", "n"])

    seen = scratch.save(map_batches(both, observe, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    rows = np.array(sorted(tuple(r) for r in seen.collect()), np.int64).reshape(-1, 2)  # a fixed number of cells
    weights = learn(np.stack(np.unravel_index(rows[:, 0], (2 * BUCKETS, BINS, BINS, BINS)), axis=1), rows[:, 1].astype(float), uniform)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block, c in opened(batches):
            base = np.log10((c.word + 0.5) / (total + 0.5 * (distinct + 1)))
            w = weights[bucket(c.before, c.before2)]
            mixed = w[:, 2] * c.word / max(total, 1) + w[:, 3] * uniform
            for k, n, context in ((0, c.triple, c.before2), (1, c.pair, c.before)):
                # where a context has not been seen, the weight of its order goes to the uniform share
                mixed += w[:, k] * np.where(context > 0, n / np.maximum(context, 1), uniform)
            add = lambda x: np.add.reduceat(x, block.first)
            columns = [pa.array(ids, pa.int64()), pa.array(~in_training(ids)), pa.array(block.sizes, pa.int64()), pa.array(add((c.word > 0).astype(np.int64)), pa.int64()), pa.array([total] * len(ids), pa.int64()), pa.array(add(base)), pa.array(add(np.log10(mixed)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return map_batches(both, rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

"""Near copies by SimHash: texts whose sets of word shingles have a Jaccard similarity of at least 0.8, grouped.

The shards of the BK-trees are chosen by shingles here, not by blocks of bits, as RADIUS bits leave no equal blocks:
shingles are ranked, rare ones first, and two sets of that similarity share one of the first n / 5 + 1 shingles of each
(prefix filter), so the sets that share such a key are a shard. Ranks come from a bounded sample of documents: any one
order for all sets is lossless, a good one only saves work. In a shard, BK-trees of the fingerprints (``simhash``) give
the pairs within RADIUS bits. Two sets of Jaccard 0.8 differ in some 10 of 64 bits on average, in 12 if they are tiny;
of such pairs 28 bits lose about one in a million, and none that is nearer by much. What passes the bounds of size and
place that no similar pair can fail is compared shingle by shingle, so there are no false links. Random pairs pass
those bounds often, and more than in proportion to the corpus, so whole sets travel only for pairs whose parities, one or two bits
a shingle, pass as well: each bit that differs stands for a shingle that only one of the two has. Keys are dealt in
PASSES parts, and a table is dropped when nothing reads it any more.

A group of n near copies is not compared n * n times: each key first links its sets to one of them, a key of many sets to
PIVOTS of them (near copies of one text may be too far from each other for one), and only sets that are still in
different components look for each other. A key of more than SHARD sets is cut into salts, each with its
own tree, and every pair of salts is a shard.

Defined results: as in ``simhash``, texts are compared after lower-casing A-Z; a text under WORDS words is one
shingle; texts with equal sets, blank ones too, are copies; rows are told apart by doc_id and text, and rows without
an id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, grouped, map_batches, texts
from tessera.llm.simhash import SHARD, BKTree, bits, components

#: Similarity is NUM / DEN, and RADIUS the bits in which fingerprints may differ. SAMPLE documents, about, give the ranks of at most COMMON shingles.
WORDS, NUM, DEN, RADIUS, SAMPLE, COMMON = 5, 4, 5, 28, 4000, 1 << 16
#: Parts in which keys are dealt (a power of two), and most bits of the map of the documents whose sets are wanted.
PASSES, MAP_BITS = 4, 25
#: Keys of over MANY sets first link them to PIVOTS of theirs, others to one: under a fifth of the pairs that their shards look at.
MANY, PIVOTS = 256, 24


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    import xxhash

    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(s) for s in zip(*(w[k:] for k in range(words)))] if len(w) >= words else [b" ".join(w)]
    return np.unique(np.array([*map(xxhash.xxh64_intdigest, parts)], np.uint64))


def identity(own: np.ndarray) -> int:
    """The set as a signed 64-bit hash."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def prefix(own: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the order of (times in the sample, hash): as many as a similar set can't miss."""
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.lexsort((own, np.where(common[at] == own, times[at], 0)))]
    return own[: len(own) - -(-NUM * len(own) // DEN) + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def parities(own: np.ndarray) -> bytes:
    """Whether each bucket holds an odd number of the set's shingles. There are n to 2n buckets, 64 at least, a power of two."""
    size = max(64, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which parities differ, the longer folded: two sets have at least so many shingles that the other has not."""
    p, q = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    a, b = 8 * len(x), 8 * len(y)
    if a < b:
        p, q, a, b = q, p, b, a
    while a > b:
        a //= 2
        p = (p >> a) ^ (p & ((1 << a) - 1))
    return (p ^ q).bit_count()


def ranks(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that stand in more than one document of the sample, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["h"])

    every = max(1, docs.count() // SAMPLE)
    sample = texts(docs).filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(every)) == 0)
    rows = map_batches(sample, run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    found = np.array([(r["h"], r["n"]) for r in rows], np.int64).reshape(-1, 2)
    common, times = found[:, 0].copy().view(np.uint64), found[:, 1].copy()
    order = np.argsort(common)
    return common[order], times[order]


def sets(docs: DataFrame, common: np.ndarray, times: np.ndarray) -> DataFrame:
    """doc_id, th (hash of the text), its set's identity, size, fingerprint, parities and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t) for t in batch.column("text").to_pylist()]
            fps = np.array([bits(s) for s in own], np.uint64).view(np.int64)
            cols = [batch.column("doc_id"), batch.column("th"), pa.array([identity(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int32()), pa.array(fps, pa.int64()), pa.array([parities(s) for s in own], pa.binary()), pa.array([prefix(s, common, times).view(np.int64) for s in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "sid", "n", "fp", "odd", "keys"])

    return map_batches(texts(docs).withColumn("th", F.xxhash64("text")), run, "doc_id long, th long, sid long, n int, fp long, odd binary, keys array<long>")


def shared(rows: DataFrame) -> DataFrame:
    """The rows (key, sid, pos) whose key has more than one: one shuffle, read in order, of which only the last row is held."""
    schema = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = pa.Table.from_batches([], schema=schema), False  # the last row, and whether it has been passed on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_tables([last, pa.Table.from_batches([batch.cast(schema)])])
            key = rows.column("key").to_numpy()
            same = key[1:] == key[:-1]
            keep = np.zeros(len(key), bool)
            keep[1:] |= same
            keep[:-1] |= same
            end = bool(keep[-1])
            if last.num_rows and told:
                keep[0] = False
            last, told = rows.slice(len(key) - 1), end
            yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    return map_batches(rows.select("key", "sid", "pos").repartition("key").sortWithinPartitions("key"), run, "key long, sid long, pos int")


def _near(z: Column) -> Column:
    """Whether a set and another one, z, of its key may be similar."""
    n, m = F.col("n"), z["n"]
    fits = (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((DEN + NUM) * F.least(n - F.col("pos"), m - z["pos"]) >= NUM * (n + m))
    return (F.col("sid") != z["sid"]) & fits & (F.bit_count(F.col("fp").bitwiseXOR(z["fp"])) <= RADIUS)


def to_one(rows: DataFrame) -> DataFrame:
    """(a, b): each set with the least set of its key, where they may be similar."""
    least = rows.groupBy("key").agg(F.min(F.struct("sid", "n", "pos", "fp")).alias("z"))
    return rows.join(least, "key").filter(_near(F.col("z"))).select(F.col("z.sid").alias("a"), F.col("sid").alias("b")).distinct()


def to_some(rows: DataFrame, many: int = MANY, pivots: int = PIVOTS) -> DataFrame:
    """(a, b): each set of a key of over ``many`` with ``pivots`` sets of it, where they may be similar. The least by some hashes: the same sets in many keys."""
    large = rows.join(rows.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > many).select("key"), "key")
    some = large.groupBy("key").agg(F.array(*[F.min(F.struct(F.xxhash64("sid", F.lit(s)).alias("x"), "sid", "n", "pos", "fp")) for s in range(pivots)]).alias("zs"))
    met = large.join(some, "key").select("sid", F.explode(F.transform(F.filter("zs", _near), lambda z: z["sid"])).alias("z"))
    return met.select(F.least("sid", "z").alias("a"), F.greatest("sid", "z").alias("b")).distinct()


def in_shards(rows: DataFrame, scratch: Scratch, shard: int = SHARD) -> DataFrame:
    """(a, b): the pairs of a key with unequal labels that may be similar, by BK-trees."""
    sizes = scratch.save(rows.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key", F.ceil(F.col("m") / F.lit(shard)).cast("int").alias("salts")))
    met = rows.join(sizes, "key").withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    met = met.select("key", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "sid", "n", "pos", "fp", "label")

    def run(g: dict) -> list[tuple[int, int]]:
        n, pos, label, sid = (g[c].astype(np.int64) for c in ("n", "pos", "label", "sid"))
        fps, i, j = g["fp"].view(np.uint64), g["i"][0], g["j"][0]
        kept, asked = np.flatnonzero(g["salt"] == i), np.flatnonzero(g["salt"] == j)
        values, inverse = np.unique(fps[kept], return_inverse=True)
        by_value = kept[np.argsort(inverse, kind="stable")]
        first = np.searchsorted(np.sort(inverse), np.arange(len(values) + 1))
        tree, out = BKTree(values), set()
        place = np.searchsorted(values, tree.value)  # of a node's value
        for q, node in tree.search(fps[asked], RADIUS):
            at = place[node]
            many = first[at + 1] - first[at]
            a = asked[np.repeat(q, many)]
            b = by_value[np.repeat(first[at], many) + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)]
            ok = (sid[a] < sid[b]) | (i != j)
            ok &= (label[a] != label[b]) & (DEN * np.minimum(n[a], n[b]) >= NUM * np.maximum(n[a], n[b]))
            ok &= (DEN + NUM) * np.minimum(n[a] - pos[a], n[b] - pos[b]) >= NUM * (n[a] + n[b])
            out.update((int(min(x, y)), int(max(x, y))) for x, y in zip(sid[a[ok]], sid[b[ok]]))
        return sorted(out)

    return grouped(met, ["key", "i", "j"], run, "a long, b long").distinct()


def plausible(once: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be similar by their parities: with Jaccard NUM / DEN, the shingles of only one set are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
            good = pa.array([(DEN + NUM) * apart(p, q) <= (DEN - NUM) * (i + j) for i, j, p, q in zip(n, m, x, y)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    of = lambda sid, n, odd: once.select(F.col("sid").alias(sid), F.col("n").alias(n), F.col("odd").alias(odd))
    return map_batches(found.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y"), run, "a long, b long")


def marked(ids: DataFrame, most: int) -> np.ndarray:
    """A map of bits, as bytes, in which the slot of every doc_id is set; others may be set as well. most: the number of ids, about."""
    size = 1 << min(MAP_BITS, max(15, (16 * most).bit_length()))
    at = F.xxhash64("doc_id").bitwiseAND(F.lit(size - 1))
    rows = ids.select(F.shiftright(at, 15).alias("k"), at.bitwiseAND(F.lit(32767)).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = np.zeros((size >> 15, 4096), np.uint8)
    for r in rows:
        out[r["k"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def verified(docs: DataFrame, once: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs that are similar, by their whole sets."""
    found = scratch.save(plausible(once, found))
    wanted = found.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(once, "sid").select("first.doc_id")
    held = docs.sparkSession.sparkContext.broadcast(marked(wanted, 2 * found.count()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            at = batch.column("at").to_numpy() & (8 * len(bits) - 1)
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            own = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], names=["sid", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            good = pa.array([similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    own = map_batches(texts(docs).select("text", F.xxhash64("doc_id").alias("at")), whole, "sid long, own binary").dropDuplicates(["sid"])
    both = found.join(own.select(F.col("sid").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("sid").alias("b"), F.col("own").alias("y")), "b")
    out = scratch.save(map_batches(both.select("a", "b", "x", "y"), run, "a long, b long"))
    scratch.drop(found)
    return out


def near_copies(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, th (hash of the text), component_id (the smallest doc_id that links of similar texts reach) and first (whether the row, or one that repeats it, stands for its component)."""
    scratch = scratch or Scratch(docs.sparkSession)
    own = scratch.save(sets(docs.filter("doc_id is not null"), *ranks(docs)))
    found = scratch.save(own.select("doc_id", "th", "sid"))
    me = F.struct("doc_id", "th")
    # copies tell the same keys; one row of each set goes on
    whole = scratch.save(own.groupBy("sid").agg(F.min(me).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "fp", "odd", "keys")]))
    scratch.drop(own)
    once = scratch.save(whole.drop("keys"))
    keyed = whole.select("sid", F.posexplode("keys").alias("pos", "key"))
    parts = [scratch.save(shared(keyed.filter(F.col("key").bitwiseAND(F.lit(PASSES - 1)) == k))) for k in range(PASSES)]
    scratch.drop(whole)
    rows = scratch.save(reduce(DataFrame.unionAll, parts).join(once.select("sid", "n", "fp"), "sid"))
    scratch.drop(*parts)
    pairs = scratch.save(to_one(rows).union(to_some(rows)).distinct())
    edges = verified(docs, once, pairs, scratch)
    tree = scratch.save(components(edges, scratch))
    labelled = scratch.save(rows.join(tree.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("label", F.coalesce("root", "sid")).drop("root"))
    scratch.drop(rows, pairs)
    pairs = scratch.save(in_shards(labelled, scratch))
    scratch.drop(labelled)
    more = verified(docs, once, pairs, scratch)
    scratch.drop(pairs)
    if not more.isEmpty():
        tree = components(edges.union(more), scratch)
    # the smallest row of each component; one document alone needs no row
    rooted = once.select("sid", "first", "copies").join(tree.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = scratch.save(rooted.groupBy("root").agg(F.min("first").alias("least"), F.sum("copies").alias("docs")).filter("docs > 1"))
    whole = scratch.save(rooted.join(least, "root").select("sid", "least"))
    stands = F.col("least").isNull() | (F.col("least") == me)
    return found.join(whole, "sid", "left").select("doc_id", "th", F.coalesce("least.doc_id", "doc_id").alias("component_id"), stands.alias("first"))

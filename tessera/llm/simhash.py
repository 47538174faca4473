"""SimHash near-duplicates: fingerprints of word shingles, linked by BK-trees, grouped into components.

Two 64-bit fingerprints that differ in at most ``radius`` bits agree on at least ``BLOCKS - radius`` of BLOCKS equal
blocks. Agreement chooses the shards: fingerprints that share the bits of a block combination meet in one. A group of
more than ``SHARD`` fingerprints is dealt anew by one of ``radius + 1`` equal parts of the bits that are left, on one
of which every linked pair agrees again, until the groups fit; as fingerprints are distinct, a group whose
combination leaves b bits has 2^b at most, so this ends, no link is lost and no shard outgrows its bound.

Each shard builds one BK-tree (children keyed by their Hamming distance to the parent), packed into arrays. Trees of
BROADCAST_BYTES together, by their counted nodes, are broadcast, and every fingerprint looks into the trees of its
shards where it lies; more of them stay in the tasks of their shards, and the fingerprints are sent there. A search
follows only the edges within the radius, for all fingerprints of a batch at once. Batches return a spanning forest of
their links, which is all that components need.

Defined results: texts are compared after lower-casing A-Z; a null, empty or blank text has fingerprint zero and
links like any other; ties and repeated rows share one fingerprint, so they are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, grouped, map_batches, table, texts

#: Production parameters: words of a shingle, seed, bits that may differ, blocks, fingerprints of a shard, bytes of all trees that are broadcast.
SHINGLE_WORDS, SEED, RADIUS, BLOCKS, SHARD, BROADCAST_BYTES = 3, 42, 2, 4, 4096, 8 << 20
#: Bytes of a node in a packed tree: value, edge to the parent, first child.
NODE_BYTES = 13


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text."""
    import xxhash

    w = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and ASCII white space
    if not w:
        return 0
    shingles = [b" ".join(s) for s in zip(*(w[k:] for k in range(words)))] if len(w) >= words else [b" ".join(w)]
    return bits(np.array([*map(xxhash.xxh64_intdigest, shingles, [seed] * len(shingles))], np.uint64))


def bits(hashed: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 14):
        ones += np.unpackbits(hashed[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and its fingerprint, as the long of the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return map_batches(texts(docs), run, "doc_id long, fp long")


class BKTree:
    """Distinct 64-bit integers under Hamming distance; a child hangs at its distance to the parent.

    Nodes are numbered so that the children of one follow each other, by distance: value, edge (distance to the
    parent) and first (the first child; the next node's first ends them).
    """

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.uint64)
        children: list[dict[int, int]] = [{} for _ in range(len(values))]
        ints = values.tolist()
        for new in range(1, len(ints)):
            at, v = 0, ints[new]
            while at != new:
                at = children[at].setdefault((ints[at] ^ v).bit_count(), new)
        order, edge, first = [0] if ints else [], [0] if ints else [], []
        for at in order:  # grows as it is read: breadth first
            first.append(len(order))
            for d in sorted(children[at]):
                order.append(children[at][d])
                edge.append(d)
        self.value = values[order] if ints else values
        self._set(np.array(edge, np.uint8), np.array([*first, len(ints)], np.int64))

    def _set(self, edge: np.ndarray, first: np.ndarray) -> None:
        self.edge, self.first = edge, first
        parent = np.repeat(np.arange(len(edge)), np.diff(first))  # of nodes 1 and on
        self.key = parent * 256 + edge[1:]

    def pack(self) -> bytes:
        return b"".join((self.value.tobytes(), self.edge.tobytes(), self.first[:-1].astype(np.uint32).tobytes()))

    @classmethod
    def unpack(cls, packed: bytes) -> BKTree:
        n = len(packed) // NODE_BYTES
        out = cls.__new__(cls)
        out.value = np.frombuffer(packed, np.uint64, n)
        out._set(np.frombuffer(packed, np.uint8, n, 8 * n), np.append(np.frombuffer(packed[9 * n :], np.uint32, n), n).astype(np.int64))
        return out

    def search(self, queries: np.ndarray, radius: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) numbers of all pairs within the radius. From a node at distance d only edges of d - radius to d + radius can lead to one."""
        queries = np.asarray(queries, np.uint64)
        step = max(1, most // max(len(self.value), 1))  # a batch meets at most ``most`` nodes at once
        for low in range(0, len(queries) if len(self.value) else 0, step):
            q = np.arange(low, min(low + step, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(self.value[node] ^ queries[q]).astype(np.int64)
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                a = np.searchsorted(self.key, node * 256 + np.maximum(d - radius, 0))
                b = np.searchsorted(self.key, node * 256 + np.minimum(d + radius, 255), side="right")
                n = b - a
                q = np.repeat(q, n)
                node = np.repeat(a + 1, n) + np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)


class Forest:
    """Union-find over whatever can be a key; ``join`` says if it has united two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        while (b := up.setdefault(a, a)) != a:
            up[a] = a = up[b]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def tree_links(tree: BKTree, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between queries and the nodes of a tree."""
    queries = np.asarray(queries, np.uint64)
    forest, out = Forest(), []
    for q, node in tree.search(queries, radius):
        a, b = tree.value[node], queries[q]
        other = a != b
        out += [(x, y) for x, y in zip(a[other].tolist(), b[other].tolist()) if forest.join(x, y)]
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _finer(mask: int, radius: int) -> list[int]:
    """The mask with each of ``radius + 1`` equal parts of the bits that it leaves; none where so few are left that a group is small."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) <= 3 * (radius + 1):
        return []
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def shards(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD, scratch: Scratch | None = None) -> tuple[DataFrame, int]:
    """(shard, fp) so that every pair within the radius meets in a shard, and the number of rows. distinct: one column fp, without repeats or nulls."""
    scratch = scratch or Scratch(distinct.sparkSession)
    width = 64 // blocks
    masks = [sum(((1 << width) - 1) << (width * b) for b in combo) for combo in combinations(range(blocks), blocks - radius)]
    own = distinct.select("fp", F.explode(F.array(*[F.lit(k) for k in range(len(masks))])).alias("path"))
    done: list[DataFrame] = []
    while masks:
        by_path = F.element_at(F.array(*[F.lit(_signed(m)) for m in masks]), F.col("path") + 1)
        keyed = own.withColumn("key", F.col("fp").bitwiseAND(by_path))
        # counts first: fingerprints alone in their combination, nearly all, go no further
        sizes = scratch.save(keyed.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1"))
        finer = [_finer(m, radius) for m in masks]
        small = F.col("n") <= shard if all(finer) else F.lit(True)
        met = keyed.join(sizes, ["path", "key"])
        done.append(met.filter(small).select(F.xxhash64(F.lit(len(done)), "path", "key").alias("group"), "fp"))
        if not all(finer) or sizes.filter(~small).isEmpty():
            break
        more = F.array(*[F.array(*[F.lit(k * (radius + 1) + j) for j in range(radius + 1)]) for k in range(len(masks))])
        own = scratch.save(met.filter(~small).select("fp", F.explode(F.element_at(more, F.col("path") + 1)).alias("path")))
        masks = [m for parts in finer for m in parts]
    placed = scratch.save(reduce(DataFrame.unionAll, done))
    n = placed.count()
    at = F.pmod("group", F.lit(max(1, -(-n // shard)))).alias("shard")
    return scratch.save(placed.select(at, "fp").distinct()), n


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD, broadcast_bytes: int = BROADCAST_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """(a, b) pairs of fingerprints within the radius whose components are those of all such pairs."""
    spark = distinct.sparkSession
    scratch = scratch or Scratch(spark)
    placed, n = shards(distinct, radius, blocks, shard, scratch)

    def signed(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        return [(_signed(a), _signed(b)) for a, b in found]

    def inside(group: dict) -> list[tuple[int, int]]:
        fps = group["fp"].view(np.uint64)
        return signed(tree_links(BKTree(fps), fps, radius))

    if n * NODE_BYTES > broadcast_bytes:
        return grouped(placed, ["shard"], inside, "a long, b long").distinct()

    def plant(group: dict) -> list[tuple[int, bytes]]:
        return [(int(group["shard"][0]), BKTree(group["fp"].view(np.uint64)).pack())]

    trees = spark.sparkContext.broadcast({r["shard"]: r["tree"] for r in grouped(placed, ["shard"], plant, "shard long, tree binary").collect()})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {}
        rows = pa.Table.from_batches([*batches], schema=pa.schema([("shard", pa.int64()), ("fp", pa.int64())]))  # of trees that fit into a broadcast
        at, fps = (rows.column(c).to_numpy() for c in ("shard", "fp"))
        out: list[tuple[int, int]] = []
        for k in np.unique(at).tolist():
            tree = opened.setdefault(k, BKTree.unpack(trees.value[k]))
            out += signed(tree_links(tree, fps[at == k].view(np.uint64), radius))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return map_batches(placed, ask, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Alternating large-star and small-star steps: every step hangs neighbours on the smallest node they can see, and
    the edge table never grows beyond its start; the rounds end when one changes nothing. Each is written, so that a
    lost executor costs one round.
    """
    scratch = scratch or Scratch(edges.sparkSession)

    written: list[DataFrame] = []

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # x: the centre; y: a neighbour
        both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
        if large:
            both = both.union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
        else:
            both = both.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        # written, so that the join below deals both sides anew and Spark can split the rows of a large centre
        least = scratch.save(both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m")))
        written.append(least)
        hung = both.join(least, "x")
        if large:
            hung = hung.filter(F.col("y") > F.col("x")).select(F.col("y").alias("a"), F.col("m").alias("b"))
        else:
            hung = hung.select(F.col("y").alias("a"), F.col("m").alias("b")).union(least.select(F.col("x").alias("a"), F.col("m").alias("b")))
        return hung.filter("a <> b").distinct()

    now = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        after = scratch.save(star(star(now, True), False))
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now, *written)
        written.clear()
        now = after
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links of fingerprints reach."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.save(fingerprints(docs, words, seed))
    first = scratch.save(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    edges = links(first.select("fp"), radius, scratch=scratch)
    tree = components(edges, scratch)
    # the smallest document of each component; one document alone needs no row
    rooted = first.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = scratch.save(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("docs")).filter("docs > 1"))
    whole = scratch.save(rooted.join(least, "root").select("fp", "component_id"))
    return found.join(whole, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

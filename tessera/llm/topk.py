"""Exact top-k search by norm-sorted inner products.

Vectors are dealt by descending norm and packed into blocks, numbered slots by descending norm. They are rotated once,
when they are packed, by the singular vectors of a bounded sample, which puts most of the length into the first
coordinates. Queries are packed too, and each starts with the k-th best score against a bounded head (blocks of the
largest norms) as its threshold. Then the slots are searched in passes, from the largest norms down, each pass over
some times as many slots as the one before: a query block is sent only to slots whose largest norm can reach one of
its thresholds (Cauchy-Schwarz), and thresholds rise between passes. Inside a block the inner product of the first
rotated coordinates plus the product of the residual norms bounds the score, and only pairs whose bound reaches the
threshold are scored, exactly. Each block returns its best k a query; ranks are taken by windows over those.

Defined results: components are floor(256 * x) as integers; vectors that are null, or hold a null or non-finite
component, and rows without an id take no part; shorter vectors count as filled up with zeros; rows that repeat an id
and a vector count once, and of rows with one id and different vectors each is a query and a candidate of its own; a
query never meets rows with its own id; equal scores go to the smaller id; scores beyond 64 bits are cut to the
nearest bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, map_batches, table

#: Production parameters: neighbours, query ids, bytes of a corpus block, queries of a block, blocks of the head, rows of the rotation's sample, share of the coordinates in a partial sum, slots of the first pass and how many times as many the next has, slots at most (blocks of one slot follow each other in norm).
K, QUERY_EVERY, BLOCK_BYTES, QUERIES, HEAD, SAMPLE, PARTIAL, PASS, SLOTS = 5, 50, 1 << 20, 256, 2, 4096, 0.25, 8, 1 << 16


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (integer components as doubles, which hold them exactly up to 2^53) and norm of the rows that take part."""
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).filter(F.forall("x", lambda x: F.coalesce(fine(x), F.lit(False))))
    # floor() of a double is a long in Spark and ends at 64 bits; x - x mod 1 has no such end
    floor = lambda y: F.when(F.abs(y) >= 2.0**52, y).otherwise(F.floor(y).cast("double"))
    own = own.withColumn("v", F.transform("x", lambda x: floor(x * 256.0)))
    return own.select("vec_id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y)).alias("norm"))


def _pack(rows: DataFrame, size: int, dims: int, rotation: np.ndarray, partial: float) -> DataFrame:
    """Blocks (block, slot, top norm, ids, matrix, head, rest) of ``size`` rows; head and rest are the first rotated coordinates and what is left of the norms. Rows of one id and vector follow each other and are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        slot = TaskContext.get().partitionId()
        ids, rows_, norms, before = [], [], [], None

        def out() -> pa.RecordBatch:
            order = np.argsort(ids, kind="stable")  # of equal scores the smaller id comes first
            m = np.zeros((len(ids), dims))
            for k, at in enumerate(order.tolist()):
                m[k, : len(rows_[at])] = rows_[at]
            turned = m @ rotation
            r = max(1, int(partial * dims))
            rest = np.sqrt((turned[:, r:] ** 2).sum(axis=1))
            packed = [np.array(ids, np.int64)[order], m, np.ascontiguousarray(turned[:, :r]), rest]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([slot], pa.int32()), pa.array([max(norms)], pa.float64()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["block", "slot", "top", "ids", "m", "head", "rest"])

        for batch in batches:
            for i, v, n in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), batch.column("norm").to_pylist()):
                if (i, v) == before:
                    continue
                before = (i, v)
                ids.append(i)
                rows_.append(v)
                norms.append(n)
                if len(ids) == size:
                    yield out()
                    ids, rows_, norms = [], [], []
        if ids:
            yield out()

    return map_batches(rows.select("vec_id", "v", "norm"), run, "block long, slot int, top double, ids binary, m binary, head binary, rest binary")


class Block:
    """Vectors of a packed block."""

    def __init__(self, row: dict, dims: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.m = np.frombuffer(row["m"], np.float64).reshape(n, dims)
        self.head = np.frombuffer(row["head"], np.float64).reshape(n, -1)
        self.rest = np.frombuffer(row["rest"], np.float64)
        self.norm = np.sqrt((self.head**2).sum(axis=1) + self.rest**2)


def exact_scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles hold them where all partial sums are below 2^53."""
    most = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(rows).max(initial=0)), 1.0) * max(q.shape[-1], 1)
    if most < 2.0**53:
        return (rows @ q).astype(np.int64)
    qs = [int(x) for x in q]
    return np.array([min(max(sum(a * int(b) for a, b in zip(qs, r)), -(1 << 63)), (1 << 63) - 1) for r in rows], np.int64)


def search_block(q: Block, c: Block, threshold: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(number of the query, id, score) of the best k rows of a block for each query, of those that reach its threshold."""
    # slack for rounding, which is far below this share of the norms' product
    bound = q.head @ c.head.T + q.rest[:, None] * c.rest[None, :] + 1e-9 * (q.norm[:, None] * c.norm[None, :] + 1)
    out = []
    for a, i in enumerate(q.ids.tolist()):
        at = np.flatnonzero((bound[a] >= threshold[a]) & (c.ids != i))
        if not len(at):
            continue
        score = exact_scores(q.m[a], c.m[at])
        if len(at) > k:
            least = np.partition(score, len(at) - k)[len(at) - k]
            keep = score >= least
            at, score = at[keep], score[keep]
        best = np.lexsort((c.ids[at], [-int(s) for s in score]) if score.min(initial=0) == -(1 << 63) else (c.ids[at], -score))[:k]
        out += [(a, int(c.ids[at[b]]), int(score[b])) for b in best]
    return out


def reach(q: Block, threshold: np.ndarray, tops: np.ndarray) -> int:
    """How many slots, of the largest norms (descending), can hold a row that reaches a query's threshold."""
    least = np.where((threshold > 0) & (q.norm > 0), threshold / np.maximum(q.norm, 1e-300) * (1 - 1e-9), -1.0)
    return int(np.searchsorted(-tops, -least.min(), side="right")) if len(least) else 0


def top_k(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY, block_bytes: int = BLOCK_BYTES, first: int = PASS, partial: float = PARTIAL, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k best other rows."""
    scratch = scratch or Scratch(embeddings.sparkSession)
    own = scratch.save(vectors(embeddings))
    dims, n = own.agg(F.max(F.size("v")), F.count("*")).first()
    dims = max(dims or 0, 1)
    share = min(1.0, SAMPLE / n) if n else 1.0
    sample = own.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE).collect()
    m = np.zeros((len(sample) + 1, dims))
    for a, row in enumerate(sample):
        m[a, : len(row["v"])] = row["v"]
    rotation = np.linalg.svd(m / max(np.abs(m).max(), 1.0), full_matrices=True)[2].T if len(sample) < dims else np.linalg.eigh(m.T @ m / max(np.abs(m).max(), 1.0) ** 2)[1][:, ::-1]
    size = max(1, block_bytes // (8 * dims))
    slots = min(SLOTS, max(1, -(-n // size)))
    ordered = own.repartitionByRange(slots, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id", "v")
    corpus = scratch.save(_pack(ordered, size, dims, rotation, partial))
    # the largest norm from each slot on, in its order: at most SLOTS numbers
    largest = {r["slot"]: r["top"] for r in corpus.groupBy("slot").agg(F.max("top").alias("top")).collect()}
    tops = np.zeros(max(largest, default=-1) + 1)
    tops[[*largest]] = [*largest.values()]
    tops = np.maximum.accumulate(tops[::-1])[::-1]
    queries = own.filter(F.col("vec_id") % every == 0).repartition(max(1, -(-(n // every) // QUERIES)), F.xxhash64("vec_id")).sortWithinPartitions("vec_id", "v")
    packed = scratch.save(_pack(queries, QUERIES, dims, rotation, partial).drop("slot", "top"))
    columns = ["ids", "m", "head", "rest"]
    head = [r.asDict() for r in corpus.orderBy("slot", F.desc("top"), "block").limit(HEAD).select(*columns).collect()]

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Block(h, dims) for h in head]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                q = Block(row, dims)
                found: list[list[int]] = [[] for _ in q.ids]
                for c in blocks:
                    for a, _, score in search_block(q, c, np.full(len(q.ids), -np.inf), k):
                        found[a].append(score)
                t = np.array([sorted(x)[-k] if len(x) >= k else -np.inf for x in found])
                rows.append((row["block"], t.tobytes(), reach(q, t, tops)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int32()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.binary(), pa.int32())], names=["block", "threshold", "reach"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                q, c = Block({x: row[f"q_{x}"] for x in columns}, dims), Block(row, dims)
                rows += [(row["qb"], a, int(q.ids[a]), i, s) for a, i, s in search_block(q, c, np.frombuffer(row["threshold"], np.float64), k)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["qb", "qn", "query_id", "vec_id", "score"])

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                t = np.frombuffer(row["threshold"], np.float64).copy()
                for x in row["best"] or ():
                    t[x["qn"]] = max(t[x["qn"]], x["score"])
                rows.append((row["block"], t.tobytes(), reach(Block(row, dims), t, tops)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int32()))], names=["block", "threshold", "reach"])

    rank = F.row_number().over(Window.partitionBy("qb", "qn").orderBy(F.desc("score"), "vec_id"))
    state = scratch.save(map_batches(packed, seed, "block long, threshold binary, reach int"))
    best, low, high = None, 0, first
    while best is None or low < len(tops):
        # the blocks of queries go along once for each of their slots in this pass
        asked = state.filter(F.col("reach") > low).select(F.col("block").alias("qb"), "threshold", F.explode(F.sequence(F.lit(low), F.least("reach", F.lit(high)) - 1)).alias("slot"))
        asked = asked.join(packed.select(F.col("block").alias("qb"), *(F.col(c).alias(f"q_{c}") for c in columns)), "qb")
        met = asked.join(corpus.filter(F.col("slot").between(low, high - 1)).select("slot", *columns), "slot")
        found = map_batches(met.select("qb", "threshold", *(f"q_{c}" for c in columns), *columns), search, "qb long, qn int, query_id long, vec_id long, score long")
        found = found if best is None else found.union(best)
        best = scratch.save(found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"))
        low, high = high, high * (first + 1)
        if low < len(tops):
            last = best.withColumn("rank", rank).filter(F.col("rank") == k).groupBy("qb").agg(F.collect_list(F.struct("qn", "score")).alias("best"))  # a number for each query of a block
            state = scratch.save(map_batches(state.drop("reach").join(packed, "block").join(last.withColumnRenamed("qb", "block"), "block", "left"), raised, "block long, threshold binary, reach int"))
    return best.withColumn("rank", rank).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: Integer inner products of all pairs, ranked for each query row.
OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.v AS q, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

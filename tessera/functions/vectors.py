"""Vector scores as double expressions in element order; unrolled, so that they stay in generated code."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.schema import Metric, QueryError

#: Longest vector whose sum is one expression; deeper trees overrun the planner's stack.
UNROLL = 128


def query_vector(vector: list[float], dims: int, normalize: bool) -> list[float]:
    """Checked, and scaled to length one in single precision as stored vectors are."""
    if len(vector) != dims or not all(math.isfinite(x) for x in vector):
        raise QueryError(f"the query vector must have {dims} finite components")
    x = np.array(vector, np.float32)
    if normalize:
        norm = np.sqrt(reduce(lambda s, y: np.float32(s + y * y), x, np.float32(0)))
        if not norm > 0:
            raise QueryError("a query vector of length zero can't be normalised")
        x = (x / norm).astype(np.float32)
    return [float(v) for v in x]


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot(v: Column, q: list[float]) -> Column:
    if len(q) <= UNROLL:
        return _sum([F.get(v, F.lit(i)).cast("double") * F.lit(float(x)) for i, x in enumerate(q)])
    pairs = F.zip_with(v, F.array(*map(F.lit, map(float, q))), lambda a, b: a.cast("double") * b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def square(v: Column, dims: int) -> Column:
    if dims <= UNROLL:
        return _sum([F.get(v, F.lit(i)).cast("double") * F.get(v, F.lit(i)).cast("double") for i in range(dims)])
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def score(v: Column, q: list[float], metric: Metric) -> Column:
    """Higher is better: the inner product, the cosine (0 if either length is 0), or minus the Euclidean distance."""
    if metric is Metric.DOT:
        return dot(v, q)
    if metric is Metric.COSINE:
        norm = math.sqrt(sum(x * x for x in q))
        own = F.sqrt(square(v, len(q)))
        return F.lit(0.0) if norm == 0 else F.when(own == 0, 0.0).otherwise(dot(v, q) / (own * norm))
    if len(q) <= UNROLL:
        return -F.sqrt(_sum([(F.get(v, F.lit(i)).cast("double") - float(x)) * (F.get(v, F.lit(i)).cast("double") - float(x)) for i, x in enumerate(q)]))
    gaps = F.zip_with(v, F.array(*map(F.lit, map(float, q))), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return -F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """Scaled to length one, each step in single precision; null where the length is zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("float"), lambda s, x: (s + (x * x).cast("float")).cast("float")).cast("double")).cast("float")
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm.cast("double")).cast("float")))


def valid(v: Column, dims: int) -> Column:
    """Whether the array is a vector of that many finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(v) == dims) & F.forall(v, fine), F.lit(False))

"""Facets and numeric aggregates over all visible matches, whatever the page."""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.project import null_mark, present
from tessera.plans.schema import Capability, Field, FieldType, IndexSpec, QueryError

MOST_BUCKETS, MOST_COMPUTATIONS = 1000, 32
OPS = ("count", "min", "max", "sum", "avg")


@dataclass(frozen=True)
class Facet:
    field: str
    limit: int = 10


@dataclass(frozen=True)
class Aggregate:
    field: str
    op: str


def validate(spec: IndexSpec, facets: tuple[Facet, ...], aggregates: tuple[Aggregate, ...]) -> None:
    if len(facets) + len(aggregates) > MOST_COMPUTATIONS:
        raise QueryError(f"at most {MOST_COMPUTATIONS} computations")
    if len({f.field for f in facets}) != len(facets) or len(set(aggregates)) != len(aggregates):
        raise QueryError("each computation is asked for once")
    for f in facets:
        if not spec.field(f.field).can(Capability.FACET) or not 1 <= f.limit <= MOST_BUCKETS:
            raise QueryError(f"no facet of {f.limit} over {f.field}")
    for a in aggregates:
        if not spec.field(a.field).can(Capability.AGGREGATE) or a.op not in OPS:
            raise QueryError(f"no {a.op} over {a.field}")


def buckets(rows: DataFrame, f: Field) -> DataFrame:
    """(value, count) of documents by distinct value; an explicit null is a bucket, missing and empty cells are none."""
    if not f.multi:
        return rows.filter(F.col(present(f.name))).groupBy(F.col(f.name).alias("value")).agg(F.count("*").alias("count"))
    null = F.when(F.col(null_mark(f.name)), F.array(F.lit(None).cast(f.type.spark))).otherwise(F.array().cast(f"array<{f.type.spark}>"))
    each = F.explode(F.concat(F.array_distinct(F.coalesce(f.name, F.array().cast(f"array<{f.type.spark}>"))), null))
    return rows.select(each.alias("value")).groupBy("value").agg(F.count("*").alias("count"))


def scalar_json(f: Field, value: Column) -> Column:
    """The value as canonical JSON text, which settles the order of equal counts in the output."""
    if f.type in (FieldType.KEYWORD, FieldType.TEXT):
        text = F.substring(F.to_json(F.array(value)), 2, 1 << 30)
        text = F.left(text, F.length(text) - 1)
    elif f.type is FieldType.FLOAT:
        text = F.to_json(F.array(value))
        text = F.substring(text, 2, 1 << 30)
        text = F.left(text, F.length(text) - 1)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(text)


def facet(rows: DataFrame, spec: IndexSpec, wanted: Facet) -> DataFrame:
    """(value, json, count): the buckets kept are cut by count and typed value, and shown by count and JSON text."""
    f = spec.field(wanted.field)
    top = buckets(rows, f).orderBy(F.desc("count"), F.asc_nulls_first("value")).limit(wanted.limit)
    return top.withColumn("json", scalar_json(f, F.col("value"))).orderBy(F.desc("count"), "json")


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def expression(f: Field, op: str) -> Column:
    """One aggregate over the values (not the documents) of a field."""
    v = F.col(f.name)
    count = F.coalesce(F.sum(F.coalesce(F.size(v), F.lit(0))) if f.multi else F.count(v), F.lit(0)).cast("long")
    if op == "count":
        return count
    if op in ("min", "max"):
        one = {"min": (F.min, F.array_min), "max": (F.max, F.array_max)}[op]
        return one[0](one[1](v) if f.multi else v)
    if f.type is FieldType.FLOAT:
        total = F.sum(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) if f.multi else v)
        total = F.when(F.isnan(total) | (F.abs(total) == float("inf")), F.raise_error(f"the sum of {f.name} isn't finite").cast("double")).otherwise(total)
        total = F.when(count > 0, total)
        return total if op == "sum" else total / count
    total = F.sum(F.aggregate(v, _wide(F.lit(0)), lambda s, x: _wide(s + _wide(x))) if f.multi else _wide(v))
    if op == "avg":
        return F.when(count > 0, total.cast("double") / count)
    low, high = (-(1 << 63), (1 << 63) - 1) if f.type is FieldType.SIGNED else (0, (1 << 64) - 1)
    bad = (total < F.lit(Decimal(low))) | (total > F.lit(Decimal(high)))
    return F.when(count > 0, F.when(bad, F.raise_error(f"the sum of {f.name} is out of range").cast("decimal(38,0)")).otherwise(total)).cast(f.type.spark)


def aggregate(rows: DataFrame, spec: IndexSpec, wanted: tuple[Aggregate, ...]) -> DataFrame:
    """One row with a column for each aggregate, all in one pass, and the number of values behind each field."""
    columns = [expression(spec.field(a.field), a.op).alias(f"{a.op}_{a.field}") for a in wanted]
    columns += [expression(spec.field(n), "count").alias(f"contributing_{n}") for n in dict.fromkeys(a.field for a in wanted)]
    return rows.agg(*columns)


def cube(rows: DataFrame, spec: IndexSpec, names: list[str], rollup: bool = False) -> DataFrame:
    """Extension: counts over several single-valued facets at once."""
    for n in names:
        if not spec.field(n).can(Capability.FACET) or spec.field(n).multi:
            raise QueryError(f"no cube over {n}")
    grouped = rows.rollup(*names) if rollup else rows.cube(*names)
    return grouped.agg(F.count("*").alias("count"), F.grouping_id().alias("grouping"))


def json_text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)

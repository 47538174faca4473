"""Corpus normalisation: records exploded by what they affect, grouped by canonical package, hashed and partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "id string, modified string, withdrawn string, aliases array<string>, affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>>>"


def clean(text: Column) -> Column:
    """Trimmed; empty is null."""
    return F.nullif(F.trim(text), F.lit(""))


def clean_all(values: Column) -> Column:
    """Trimmed, without empties and repeats, sorted."""
    cleaned = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x != "")))


def ecosystem_key(ecosystem: Column) -> Column:
    """One name for each ecosystem."""
    low = F.lower(F.trim(ecosystem))
    return F.when(low == "cargo", "crates.io").otherwise(low)


def package_key(ecosystem: Column, name: Column) -> Column:
    """The name by the rules of its (canonical) ecosystem."""
    name = F.trim(name)
    pypi = F.regexp_replace(F.regexp_replace(F.lower(name), "[_.]", "-"), "-+", "-")
    return F.when(ecosystem == "pypi", pypi).when(ecosystem == "npm", F.lower(name)).otherwise(name)


def timestamp_day(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("unknown"))


def records(source: DataFrame, known: list[str] | None = None) -> DataFrame:
    """A row for each (record, canonical package), and one ``unscoped`` row for what has no package.

    source has the columns of RECORD. Records without an id are malformed and left out.
    """
    own = source.withColumn("id", clean(F.col("id"))).filter("id is not null")
    each = own.select("id", "modified", "withdrawn", "aliases", F.explode_outer("affected").alias("item"))
    eco = ecosystem_key(clean(F.col("item.package.ecosystem")))
    name = package_key(eco, clean(F.col("item.package.name")))
    scoped = eco.isNotNull() & name.isNotNull()
    each = each.select("id", "modified", "withdrawn", "aliases", F.when(scoped, eco).otherwise("unscoped").alias("ecosystem"), F.when(scoped, name).otherwise(F.col("id")).alias("package"), F.coalesce("item.versions", F.array().cast("array<string>")).alias("versions"), F.col("item").isNotNull().alias("there"))
    out = each.groupBy("id", "ecosystem", "package").agg(F.first("modified").alias("modified"), F.first("withdrawn").alias("withdrawn"), F.first("aliases").alias("aliases"), F.sum(F.col("there").cast("int")).alias("affected"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("versions")))).alias("versions"))
    out = out.select("id", "ecosystem", "package", clean_all(F.col("aliases")).alias("aliases"), "affected", "versions", timestamp_day(F.col("modified")).alias("modified_day"), (clean(F.col("withdrawn")).isNotNull()).alias("withdrawn"))
    out = out.withColumn("identity_hash", F.sha2(F.concat_ws("\1", "id", "ecosystem", "package"), 256))
    body = F.to_json(F.struct("id", "ecosystem", "package", "aliases", "affected", "versions", "modified_day", "withdrawn"))
    out = out.withColumn("content_hash", F.sha2(body, 256)).withColumn("state", F.when(F.col("withdrawn"), "withdrawn").otherwise("active"))
    part = F.col("ecosystem") if known is None else F.when(F.col("ecosystem").isin(known), F.col("ecosystem")).otherwise("other")
    return out.withColumn("partition", part)


def nearest_rank(df: DataFrame, value: str, ranks: list[float], by: list[str] | None = None) -> DataFrame:
    """Mean and nearest-rank percentiles."""
    parts = [F.avg(value).alias("mean")] + [F.expr(f"percentile_disc({r}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(r * 100)}") for r in ranks]
    return df.groupBy(*(by or [])).agg(*parts)

"""Usage by prefix: live objects, stored bytes and traffic, as a baseline over versions and as signed changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import prefixes


def enable(wanted: DataFrame, prefix: str) -> DataFrame:
    """The enabled prefixes with one more; its usage starts with a ``baseline``."""
    return wanted.union(wanted.sparkSession.createDataFrame([(prefix,)], "prefix string")).distinct()


def disable(wanted: DataFrame, prefix: str) -> DataFrame:
    return wanted.filter(F.col("prefix") != prefix)


def by_prefix(df: DataFrame, wanted: DataFrame, *sums) -> DataFrame:
    """Sums over every enabled prefix that a row's path is equal to or below; overlapping ones each count."""
    each = df.withColumn("prefix", F.explode(prefixes(F.col("path"))))
    return each.join(wanted.select("prefix").distinct(), "prefix").groupBy("prefix").agg(*sums)


def baseline(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """prefix, objects (live paths) and stored_bytes (of all retained versions). versions: path, version, deleted, length."""
    per_path = versions.groupBy("path").agg(F.max_by("deleted", "version").alias("deleted"), F.sum(F.coalesce("length", F.lit(0))).alias("bytes"))
    return by_prefix(per_path, wanted, F.sum(F.when(F.col("deleted"), 0).otherwise(1)).alias("objects"), F.sum("bytes").alias("stored_bytes"))


def transitions(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Signed sums of changes (path, was_live, is_live, bytes_delta)."""
    step = F.col("is_live").cast("int") - F.col("was_live").cast("int")
    return by_prefix(changes, wanted, F.sum(step).alias("objects"), F.sum("bytes_delta").alias("stored_bytes"))


def apply(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state after signed changes; a count below zero is an error."""
    both = state.unionByName(delta).groupBy("prefix").agg(F.sum("objects").alias("objects"), F.sum("stored_bytes").alias("stored_bytes"))
    bad = F.raise_error(F.concat(F.lit("usage below zero under "), "prefix"))
    return both.select("prefix", *[F.when(F.col(c) < 0, bad.cast("long")).otherwise(F.col(c)).alias(c) for c in ("objects", "stored_bytes")])


def traffic(batches: DataFrame, wanted: DataFrame) -> DataFrame:
    """In and out bytes by prefix; a batch (batch_id) that comes again counts once."""
    once = batches.dropDuplicates(["batch_id", "path"])
    return by_prefix(once, wanted, F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))

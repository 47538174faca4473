"""Reading versioned objects: heads, versions, lists, point reads, batches, and other tables as objects."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import paths
from tessera.plans.schema import QueryError

MOST_LISTED, MOST_BATCH = 1000, 1000


def as_objects(df: DataFrame, path: Column, version: Column | int = 1, payload: Column | None = None, content_type: str = "application/json") -> DataFrame:
    """Rows of any table as live objects; without a payload column the row itself, as JSON, when it is read."""
    v = version if isinstance(version, Column) else F.lit(version)
    extra = [payload.alias("payload")] if payload is not None else []
    return df.select("*", path.alias("path"), v.cast("decimal(20,0)").alias("version"), F.lit(content_type).alias("content_type"), F.lit(False).alias("deleted"), *extra)


def current_heads(versions: DataFrame) -> DataFrame:
    """The newest version of every path, tombstones included: one partial aggregate, no window."""
    rest = [c for c in versions.columns if c not in ("path", "version")]
    newest = versions.groupBy("path").agg(F.max_by(F.struct("version", *rest), "version").alias("h"))
    return newest.select("path", "h.*")


def snapshot(log: DataFrame, fence: dict[str, int]) -> DataFrame:
    """The log's entries before one offset of each source: what a build that starts now reads, whatever is written meanwhile."""
    bound = log.sparkSession.createDataFrame([(s, float(o)) for s, o in fence.items()], "source string, _fence double")  # a row for each source
    return log.join(F.broadcast(bound), "source").filter(F.col("offset") < F.col("_fence")).drop("_fence")


def live(heads: DataFrame) -> DataFrame:
    return heads.filter(~F.col("deleted"))


def list_objects(heads: DataFrame, prefix: str = "", after: str | None = None, limit: int = MOST_LISTED) -> DataFrame:
    """Live paths under a literal prefix, behind an exclusive cursor, in byte order. One row more than the limit says that more follow."""
    if not 1 <= limit <= MOST_LISTED:
        raise QueryError(f"a list has 1 to {MOST_LISTED} entries")
    out = live(heads).filter(F.col("path").startswith(prefix))
    if after is not None:
        out = out.filter(F.col("path") > after)
    return out.orderBy("path").limit(limit + 1)


def merge_sources(sources: list[DataFrame]) -> DataFrame:
    """The union of sources that own disjoint paths; a path in two of them is an error."""
    every = reduce(lambda a, b: a.unionByName(b), [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)])
    n = F.count("*").over(Window.partitionBy("path"))
    return every.withColumn("_n", n).withColumn("path", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two sources own "), "path")).cast("string")).otherwise(F.col("path"))).drop("_n", "_source")


def point_read(spark: SparkSession, heads: DataFrame, path: str) -> DataFrame:
    """One row (path, version, state): present, deleted (with its version) or never."""
    asked = spark.createDataFrame([(path,)], "path string")
    state = F.when(F.col("version").isNull(), "never").when(F.col("deleted"), "deleted").otherwise("present")
    return asked.join(heads.filter(F.col("path") == path).select("path", "version", "deleted"), "path", "left").select("path", "version", state.alias("state"))


def exact_version(versions: DataFrame, path: str, version: int) -> DataFrame:
    return versions.filter((F.col("path") == path) & (F.col("version") == version))


def history(versions: DataFrame, path: str) -> DataFrame:
    return versions.filter(F.col("path") == path).orderBy("version")


def batch_get(spark: SparkSession, heads: DataFrame, wanted: list[str]) -> DataFrame:
    """A row for every request, in order, found or not."""
    if len(wanted) > MOST_BATCH:
        raise QueryError(f"at most {MOST_BATCH} keys")
    asked = spark.createDataFrame([*enumerate(wanted)], "ordinal int, path string")
    own = live(heads).select("path", "version")
    return asked.join(own, "path", "left").select("ordinal", "path", "version", F.col("version").isNotNull().alias("found")).orderBy("ordinal")


def invalid_paths(objects: DataFrame) -> DataFrame:
    return objects.filter(~paths.canonical(F.col("path")))


def zip_records(spark: SparkSession, where: str, most_bytes: int = 16 << 20) -> DataFrame:
    """(archive, entry, payload, problem) of the JSON entries of ZIP archives; other entries are passed over, bad ones told."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for archive, content in zip(part["path"], part["content"]):
                try:
                    bundle = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    rows.append((archive, None, None, "not an archive"))
                    continue
                for entry in bundle.infolist():
                    if entry.is_dir() or not entry.filename.endswith(".json"):
                        continue
                    if entry.file_size > most_bytes:
                        rows.append((archive, entry.filename, None, "too large"))
                        continue
                    try:
                        text = bundle.read(entry).decode()
                        json.loads(text)
                        rows.append((archive, entry.filename, text, None))
                    except (ValueError, zipfile.BadZipFile):
                        rows.append((archive, entry.filename, None, "malformed"))
            yield pd.DataFrame(rows, columns=["archive", "entry", "payload", "problem"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(where).select("path", "content")
    return files.mapInPandas(read, "archive string, entry string, payload string, problem string")


def write_shards(records: DataFrame, where: str, by: str = "partition", rows_per_file: int = 100_000, codec: str = "gzip") -> None:
    """NDJSON shards, compressed (zstd where the cluster has its codec), a folder for each partition, rolled over by rows."""
    records.write.mode("overwrite").partitionBy(by).option("compression", codec).option("maxRecordsPerFile", rows_per_file).json(where)

"""Shared pieces of the training-data operators: table access, scratch tables, Arrow batch mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python, and bytes of the rows that an operator works on at once (a longer row is worked on alone).
ARROW_ROWS, ARROW_BYTES = 256, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset (tests), a folder of this machine."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        opt = sc._jsc.sc().getCheckpointDir()
        if not opt.isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            opt = sc._jsc.sc().getCheckpointDir()
        where = opt.get()
    return f"{where.rstrip('/')}/tessera-{sc.applicationId}"


#: Shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables in the shared folder, which cut lineage and can be dropped once they are superseded."""

    def __init__(self, spark: SparkSession, compression: str = "none"):
        # hashes, ids and packed blocks don't compress; codecs hold memory outside the heap in every writer
        self.spark, self.root, self.compression = spark, f"{scratch_root(spark)}/{uuid.uuid4().hex}", compression
        self._n = 0

    def _write(self, df: DataFrame, *by: str) -> str:
        self._n += 1
        path, before = f"{self.root}/{self._n}", self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", self.compression).partitionBy(*by).parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return path

    def _read(self, path: str, schema) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def save(self, df: DataFrame) -> DataFrame:
        return self._read(self._write(df), df.schema)

    def save_kinds(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of ``kind`` 0 and 1, each as a table of its own, from one pass."""
        path, plain = self._write(df, "kind"), df.drop("kind").schema
        for k in (0, 1):  # a kind without rows has no folder
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={k}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
        return tuple(self._read(f"{path}/kind={k}", plain) for k in (0, 1))

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded(batches: Iterator[pa.RecordBatch], most: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of at most ``most`` bytes of strings, or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if any(f(column.type) for f in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, a = np.cumsum(size), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(lambda batches: fn(bounded(batches)), schema)


def deal(df: DataFrame, part: str, parts: int) -> DataFrame:
    """Rows dealt so that each part, 0 to parts - 1, is a task of its own, and sorted by part.

    Spark deals by the hash of a column, so each part gets the first number whose hash leads to its own partition; of
    very many parts some share a task, which evens out.
    """
    spark = df.sparkSession
    if parts > 4096:
        return df.repartition(parts, part).sortWithinPartitions(part)
    tries = spark.range(parts * 40).select(F.col("id").cast("int").alias("x"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"))
    found = {r["p"]: r["x"] for r in tries.groupBy("p").agg(F.min("x").alias("x")).collect()}
    by = F.element_at(F.array(*[F.lit(found.get(p, p)) for p in range(parts)]), F.col(part) + 1)
    return df.withColumn("_deal", by).repartition(parts, "_deal").drop("_deal").sortWithinPartitions(part)


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that the text operators read; whatever else a table holds stays in the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of the table needs to clash with it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def string_bytes(column: pa.Array) -> tuple["object", "object"]:
    """A string array as (uint8 buffer, int64 offsets), nulls as empty texts."""
    import numpy as np
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict]:
    """Runs of rows with equal (integer) keys, as numpy arrays by column; the rows of a key must follow each other."""
    import numpy as np

    held: dict = {}
    for batch in batches:
        new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        held = {n: np.concatenate([held[n], new[n]]) for n in new} if held else new
        size = len(held[keys[0]])
        if not size:
            continue
        change = np.zeros(size - 1, bool)
        for k in keys:
            change |= held[k][1:] != held[k][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield {n: v[a:b] for n, v in held.items()}
        held = {n: v[cuts[-1] :] for n, v in held.items()}
    if held and len(held[keys[0]]):
        yield held


def grouped(df: DataFrame, keys: list[str], fn: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """``fn`` on every group of equal keys: rows are dealt by key, sorted, and read group by group. For groups of bounded size."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for group in groups(batches, keys):
            rows += fn(group)
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return map_batches(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def filter_batches(docs: DataFrame, keep: Callable[[], Callable[[pa.RecordBatch], "object"]]) -> DataFrame:
    """The rows of which ``keep()`` (made once a task) says so, with all their columns; needs no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = keep()
        for batch in bounded(batches):
            yield batch.filter(pa.array(good(batch), pa.bool_()))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return docs.mapInArrow(run, docs.schema)

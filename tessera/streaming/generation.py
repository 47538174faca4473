"""Materialised generations of an index: full builds, incremental batches, compaction, publication and retention.

A generation is a list of segments (folders of Parquet files) in a manifest. The manifest is written under a new
name and is complete before the pointer of the next one names it, so readers always see one whole generation. A
segment holds rows and tombstones; the highest source version of a path decides which of its rows are live, whatever
segment brought it, and of one version the newest segment, which must say the same. A path that is gone without a
version takes the highest that was known before.

Segments are written in the index's physical order, in files that follow each other, with their statistics: rows,
tombstones, versions, range of the first order column, and lengths of text fields.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import order
from tessera.plans.project import checked, project, words
from tessera.plans.schema import DefinitionError, FieldType, IndexSpec

MOST_SEGMENTS = 4096
KEEP_GENERATIONS, KEEP_SECONDS = 3, 24 * 3600
COMPACT_INPUTS = 4


@dataclass
class Manifest:
    generation: int
    fingerprint: str
    segments: list[dict] = field(default_factory=list)  # folder, bytes, statistics
    offsets: dict[str, int] = field(default_factory=dict)
    batch: int = -1
    published: float = 0.0


class Generations:
    """The generations of one index under a folder that all executors share."""

    def __init__(self, spark: SparkSession, spec: IndexSpec, where: str):
        self.spark, self.spec, self.where = spark, spec.validate(), where.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.where).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests -------------------------------------------------------------------------------------------------

    def _list(self) -> list[int]:
        at = self._path(f"{self.where}/manifests")
        if not self._fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit())

    def _read(self, generation: int) -> Manifest:
        row = self.spark.read.text(f"{self.where}/manifests/{generation}", wholetext=True).first()
        return Manifest(**json.loads(row[0]))

    def current(self) -> Manifest | None:
        """The last published generation of this definition; one of another definition counts as none."""
        found = self._list()
        last = self._read(found[-1]) if found else None
        return last if last and last.fingerprint == self.spec.fingerprint() else None

    def _publish(self, m: Manifest) -> Manifest:
        """Compare and set: the next number is claimed by a rename, which only one writer wins."""
        if len(m.segments) > MOST_SEGMENTS:
            raise RuntimeError(f"over {MOST_SEGMENTS} segments; compact first")
        m.published = time.time()
        draft = f"{self.where}/drafts/{m.generation}-{time.time_ns()}"
        self.spark.createDataFrame([(json.dumps(asdict(m)),)], "value string").coalesce(1).write.text(draft)
        self._fs.mkdirs(self._path(f"{self.where}/manifests"))
        part = next(f.getPath() for f in self._fs.listStatus(self._path(draft)) if f.getPath().getName().startswith("part-"))
        target = self._path(f"{self.where}/manifests/{m.generation}")
        if self._fs.exists(target) or not self._fs.rename(part, target):
            raise RuntimeError(f"generation {m.generation} was published by another writer")
        self._fs.delete(self._path(draft), True)
        return m

    # segments --------------------------------------------------------------------------------------------------

    def _order(self, df: DataFrame) -> list[Column]:
        """The physical order of a segment: the declared one, and then the source."""
        declared = [k for n, descending in self.spec.default_order if n in df.columns for k in order.Key(n, descending, f"{n}__present").columns()]
        return declared + [F.col(c) for c in ("source_path", "source_record") if c in df.columns]

    def _statistics(self, df: DataFrame) -> list[Column]:
        out = [F.count("*").alias("rows"), F.count(F.when(F.col("_gone"), 1)).alias("gone") if "_gone" in df.columns else F.lit(0).alias("gone"), F.min("source_version").cast("string").alias("least_version"), F.max("source_version").cast("string").alias("most_version")]
        for name, _ in self.spec.default_order[:1]:
            if name in df.columns:
                out += [F.min(name).cast("string").alias("least"), F.max(name).cast("string").alias("most")]
        for f in self.spec.fields:
            if f.type is FieldType.TEXT and words(f.name) in df.columns:
                size = F.size(F.flatten(words(f.name)))
                out += [F.count(F.when(size > 0, 1)).alias(f"docs:{f.name}"), F.sum(F.greatest(size, F.lit(0)).cast("long")).alias(f"length:{f.name}")]
        return out

    def _segment(self, df: DataFrame) -> dict:
        folder, seen = f"{self.where}/segments/{time.time_ns()}", Observation()
        if any(n in df.columns for n, _ in self.spec.default_order):
            df = df.repartitionByRange(*self._order(df))
        # the statistics are taken while the rows are written
        df.observe(seen, *self._statistics(df)).sortWithinPartitions(*self._order(df)).write.parquet(folder)
        return {"folder": folder, "bytes": int(self._fs.getContentSummary(self._path(folder)).getLength()), "statistics": dict(seen.get)}

    def _rows(self, heads: DataFrame, paths: DataFrame | None = None) -> DataFrame:
        """Index rows of the heads, and a tombstone for each that leaves none. paths: the changed ones, if not all."""
        own = heads if paths is None else heads.join(paths, "path", "left_semi")
        rows = checked(self.spec, project(self.spec, own)).withColumn("_gone", F.lit(False))
        left = own.select(F.col("path").alias("source_path"), F.col("version").cast("decimal(20,0)").alias("source_version"))
        if paths is not None:  # paths that have no head at all are gone too
            never = paths.join(heads.select("path"), "path", "left_anti").select(F.col("path").alias("source_path"), F.lit(None).cast("decimal(20,0)").alias("source_version"))
            left = left.unionByName(never)
        gone = left.join(rows.select("source_path").distinct(), "source_path", "left_anti").withColumn("_gone", F.lit(True))
        return rows.unionByName(gone, allowMissingColumns=True)

    def build(self, heads: DataFrame, offsets: dict[str, int] | None = None) -> Manifest:
        """A new generation from a snapshot of heads. The journal goes on from ``offsets``."""
        found = self._list()
        rows = self._rows(heads).filter("not _gone")
        m = Manifest((found[-1] if found else 0) + 1, self.spec.fingerprint(), [self._segment(rows)], dict(offsets or {}))
        return self._publish(m)

    def apply(self, changed: DataFrame, heads: DataFrame, offsets: dict[str, int] | None = None, batch: int = -1) -> Manifest:
        """An incremental batch: changed (path) against the exact current heads. Repeating a batch changes nothing."""
        now = self.current()
        if now is None:
            return self.build(heads, offsets)
        if 0 <= batch <= now.batch:
            return now
        paths = changed.select("path").distinct()
        segments = list(now.segments)
        if not paths.isEmpty():
            segments.append(self._segment(self._rows(heads, paths)))
        return self._publish(Manifest(now.generation + 1, now.fingerprint, segments, now.offsets | (offsets or {}), max(batch, now.batch)))

    def _load(self, segments: list[dict]) -> DataFrame:
        parts = [self.spark.read.parquet(s["folder"]).withColumn("_segment", F.lit(k)) for k, s in enumerate(segments)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out if "_gone" in out.columns else out.withColumn("_gone", F.lit(False))

    def _winners(self, every: DataFrame) -> DataFrame:
        """Of each source path the rows of its highest version; two segments that say different things of one version are an error."""
        plain = [c for c in every.columns if c not in ("_segment", "_gone") and not c.startswith("_")]
        says = F.xxhash64(F.coalesce("_gone", F.lit(False)), *[F.to_json(F.struct(c)) if "vector" == c else F.col(c) for c in plain if c != "source_version"])
        told = every.select("source_path", "source_version", "_segment", says.alias("says"))
        sides = told.groupBy("source_path", "_segment").agg(F.max("source_version").alias("v"), F.sum(F.col("says").cast("decimal(38,0)")).alias("says"), F.count("*").alias("n"))
        # a tombstone without a version takes the highest one known before it
        known = F.max("v").over(Window.partitionBy("source_path").orderBy("_segment"))
        sides = sides.withColumn("own", F.col("v").isNotNull()).withColumn("v", F.coalesce("v", known))
        best = sides.groupBy("source_path").agg(F.max(F.struct(F.coalesce("v", F.lit(-1).cast("decimal(20,0)")).alias("v"), "_segment", "own", "says", "n")).alias("w"))
        clash = sides.alias("s").join(best.alias("b"), "source_path").filter((F.col("s.v") == F.col("b.w.v")) & F.col("s.own") & F.col("b.w.own") & ((F.col("s.says") != F.col("b.w.says")) | (F.col("s.n") != F.col("b.w.n"))))
        bad = clash.select("source_path").distinct().withColumn("_clash", F.lit(True))
        kept = best.select("source_path", F.col("w._segment").alias("_segment")).join(bad, "source_path", "left")
        kept = kept.withColumn("_segment", F.when(F.col("_clash"), F.raise_error(F.concat(F.lit("two contents of one version of "), "source_path")).cast("int")).otherwise(F.col("_segment"))).drop("_clash")
        return every.join(kept, ["source_path", "_segment"], "left_semi")

    def rows(self, generation: int | None = None) -> DataFrame:
        """The live rows: of each source path those of its highest version, unless that is a tombstone."""
        m = self.current() if generation is None else self._read(generation)
        if m is None:
            raise LookupError("no generation of this definition is published; it is being rebuilt")
        every = self._load(m.segments)
        if len(m.segments) == 1:
            return every.filter("not _gone").drop("_gone", "_segment")
        return self._winners(every).filter(~F.col("_gone")).drop("_gone", "_segment")

    def statistics(self, generation: int | None = None) -> list[dict]:
        """Of each segment: rows, tombstones, versions, the range of the first order column, lengths of text fields."""
        m = self.current() if generation is None else self._read(generation)
        return [s.get("statistics", {}) for s in m.segments] if m else []

    def first(self, where: Column | None, limit: int) -> tuple[DataFrame, int]:
        """The first rows in physical order, and how many files were read for them.

        Files of a single segment follow each other in that order, so they are read from the front, twice as many each
        time, until they hold enough hits. Several segments have no order together and are read whole.
        """
        keys = order.keys(self.spec, self.spec.default_order)
        m = self.current()
        if m is None:
            raise LookupError("no generation of this definition is published; it is being rebuilt")
        hits = lambda rows: (rows if where is None else rows.filter(where)).orderBy(*order.sort_columns(keys)).limit(limit)
        if len(m.segments) > 1 or not self.spec.default_order:
            return hits(self.rows()), -1
        folder = m.segments[0]["folder"]
        files = sorted(f.getPath().toString() for f in self._fs.listStatus(self._path(folder)) if f.getPath().getName().startswith("part-"))
        schema, n = self.spark.read.parquet(folder).schema, 1
        while True:
            some = self.spark.read.schema(schema).parquet(*files[:n])
            found = hits(some.filter("not _gone").drop("_gone") if "_gone" in some.columns else some)
            if n >= len(files) or found.count() == limit:
                return found, min(n, len(files))
            n *= 2

    def compact(self, everything: bool = False) -> Manifest:
        """Rewrite neighbouring segments of one size class (or all) into one, with the same live rows."""
        now = self.current()
        tier = lambda s: max(s["bytes"], 1).bit_length()
        segments = now.segments
        if everything:
            low, high = 0, len(segments)
        else:
            low = high = 0
            for a in range(len(segments)):
                b = a
                while b < len(segments) and b - a < COMPACT_INPUTS and tier(segments[b]) == tier(segments[a]):
                    b += 1
                if b - a > high - low:
                    low, high = a, b
        if high - low < 2:
            return now
        kept = self._winners(self._load(segments[low:high])).drop("_segment")
        if low == 0:  # nothing older is left for a tombstone to hide
            kept = kept.filter("not _gone")
        merged = self._segment(kept)
        return self._publish(Manifest(now.generation + 1, now.fingerprint, [*segments[:low], merged, *segments[high:]], now.offsets, now.batch))

    def vacuum(self, keep: int = KEEP_GENERATIONS, seconds: float = KEEP_SECONDS, most_bytes: int | None = None) -> list[int]:
        """Remove generations that are neither recent nor young, the oldest beyond ``most_bytes`` in all, and segments that no other names."""
        found = self._list()
        old = [g for g in found[:-keep] if self._read(g).published < time.time() - seconds] if keep else []
        if most_bytes is not None:
            size = lambda gs: sum({s["folder"]: s["bytes"] for g in gs for s in self._read(g).segments}.values())
            left = [g for g in found if g not in old]
            while len(left) > 1 and size(left) > most_bytes:
                old.append(left.pop(0))
        still = {s["folder"] for g in found if g not in old for s in self._read(g).segments}
        for g in old:
            for s in self._read(g).segments:
                if s["folder"] not in still:
                    self._fs.delete(self._path(s["folder"]), True)
            self._fs.delete(self._path(f"{self.where}/manifests/{g}"), False)
        return old

    def follow(self, changes: DataFrame, heads, checkpoint: str):
        """A streaming query that keeps the index current. changes: a stream with path; heads(): the current heads."""

        def batch(df: DataFrame, number: int) -> None:
            seen = df.groupBy("source").agg(F.max("offset").alias("o")).collect() if {"source", "offset"} <= set(df.columns) else []
            self.apply(df, heads(), {r["source"]: r["o"] + 1 for r in seen}, number)

        return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

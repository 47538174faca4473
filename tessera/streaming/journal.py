"""The change journal: offset-ordered changes by source, watched by prefix, with checkpoints and watermarks."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.paths import has_segment, segment_prefix
from tessera.plans.schema import SYSTEM_SEGMENT

CHANGE = "source string, offset long, path string, version decimal(20,0), deleted boolean, commit_id long"


class ResumeExpired(ValueError):
    """The token is from another epoch, or behind what is retained."""


def visible(prefix: str) -> Column:
    return segment_prefix(F.col("path"), F.lit(prefix)) & ~has_segment(F.col("path"), SYSTEM_SEGMENT)


def watch(spark: SparkSession, where: str, prefix: str = "", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of invalidations under a prefix, at least once and in no order."""
    reader = spark.readStream.schema(CHANGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(where).filter(visible(prefix)).select("source", "offset", "path", "version", "deleted")


def check_contiguous(changes: DataFrame) -> DataFrame:
    """The changes, or an error where a source's offsets have a gap."""
    before = F.lag("offset").over(Window.partitionBy("source").orderBy("offset"))
    gap = before.isNotNull() & (F.col("offset") != before + 1)
    return changes.withColumn("offset", F.when(gap, F.raise_error(F.concat(F.lit("gap in the journal of "), "source")).cast("long")).otherwise(F.col("offset")))


def read_page(changes: DataFrame, start: dict[str, int], settled: dict[str, int], prefix: str = "", atomic_through: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Changes from ``start`` (inclusive) up to the settled offsets (exclusive) of each source, and where to go on.

    Changes of a commit beyond ``atomic_through`` are held back with all that follow them in their source, so the
    paths of one commit show together.
    """
    bound = changes.sparkSession.createDataFrame([(s, start.get(s, 0), end) for s, end in settled.items()], "source string, low long, high long")
    page = changes.join(F.broadcast(bound), "source").filter((F.col("offset") >= F.col("low")) & (F.col("offset") < F.col("high")))
    ends = dict(settled)
    if atomic_through is not None:
        held = page.filter(F.col("commit_id") > atomic_through).groupBy("source").agg(F.min("offset").alias("stop"))
        ends |= {r["source"]: r["stop"] for r in held.collect()}  # a row for each source
        # at most a row for each source of ``settled``
        page = page.join(F.broadcast(held), "source", "left").filter(F.col("stop").isNull() | (F.col("offset") < F.col("stop")))
    return page.filter(visible(prefix)).select("source", "offset", "path", "version", "deleted"), {s: max(start.get(s, 0), e) for s, e in ends.items()}


def seal_checkpoint(epochs: dict[str, str], offsets: dict[str, int], secret: bytes) -> str:
    """One (epoch, next offset) for each source, signed."""
    body = json.dumps({s: [epochs[s], o] for s, o in offsets.items()}, sort_keys=True).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + body).decode()


def open_checkpoint(token: str, epochs: dict[str, str], floors: dict[str, int], secret: bytes) -> dict[str, int]:
    """The offsets to go on from, if all of them are still retained."""
    raw = base64.urlsafe_b64decode(token)
    if not hmac.compare_digest(raw[:32], hmac.new(secret, raw[32:], hashlib.sha256).digest()):
        raise ResumeExpired("not a token of this service")
    found = json.loads(raw[32:])
    for source, (epoch, offset) in found.items():
        if epochs.get(source) != epoch or offset < floors.get(source, 0):
            raise ResumeExpired(f"{source} no longer has offset {offset} of epoch {epoch}")
    return {s: o for s, (_, o) in found.items()}

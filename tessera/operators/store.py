"""The mutation fold: ordered compare-and-set writes to versioned paths.

Receipts are settled first, over command ids; what is left is local to a path, so it is folded path by path in
parallel. A path's mutations are one group, read in order in bounded batches of state (only its head is carried).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODES = ("put", "put_if_absent", "put_if_version", "put_immutable", "delete", "delete_if_version", "delete_version")

OUTCOME = "seq long, command_id string, path string, outcome string, version long, deleted boolean, content_hash string"


@dataclass(frozen=True)
class BucketPolicy:
    """Prefixes (equal or below) that are written once, or by programs only. They don't overlap."""

    immutable: tuple[str, ...] = ()
    program_only: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        every = sorted([*self.immutable, *self.program_only])
        if any(_under(b, a) for a, b in zip(every, every[1:])):
            raise ValueError("policy prefixes overlap")


def _under(path: str, prefix: str) -> bool:
    return not prefix or path == prefix or path.startswith(prefix + "/")


def receipts(mutations: DataFrame) -> DataFrame:
    """Adds ``receipt``: first, replay (same command and fingerprint) or conflict. seq orders the mutations."""
    first = Window.partitionBy("command_id").orderBy("seq")
    out = mutations.withColumn("_first", F.first("fingerprint").over(first)).withColumn("_rank", F.row_number().over(first))
    state = F.when((F.col("_rank") == 1) | F.col("command_id").isNull(), "first").when(F.col("fingerprint") == F.col("_first"), "replay").otherwise("conflict")
    return out.withColumn("receipt", state).drop("_first", "_rank")


def fingerprint(df: DataFrame) -> DataFrame:
    """Adds what must be equal for a command to be a replay."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("mode", "path", "expected", "content_hash")]
    return df.withColumn("fingerprint", F.sha2(F.concat_ws("\1", *parts), 256))


def _step(head: dict | None, m: dict, policy: BucketPolicy, by_program: bool) -> tuple[str, dict | None]:
    """Outcome of one mutation and the head after it."""
    path, mode = m["path"], m["mode"]
    if any(_under(path, p) for p in policy.program_only) and not by_program:
        return "program_only", head
    frozen = any(_under(path, p) for p in policy.immutable)
    if mode == "put_immutable" and not frozen:
        return "immutable_policy_required", head
    if mode != "put_immutable" and frozen:
        return "immutable", head
    if mode == "put_immutable" and head is not None:
        same = not head["deleted"] and head["content_hash"] == m["content_hash"]
        return ("replayed" if same else "immutable"), head
    if mode == "put_if_absent" and head is not None and not head["deleted"]:
        return "precondition_failed", head
    if mode == "delete_version":  # a retained version goes; the current one leaves a tombstone
        if head is None or m["expected"] is None or not 1 <= m["expected"] <= head["version"] or head["deleted"] and m["expected"] == head["version"]:
            return "not_found", head
        if m["expected"] < head["version"]:
            return "version_removed", head
    if mode.endswith("_if_version") and (head is None or head["version"] != m["expected"]):
        return "precondition_failed", head
    if mode.startswith("delete") and (head is None or head["deleted"]):
        return "not_found", head
    gone = mode.startswith("delete")
    return "applied", {"version": (head["version"] if head else 0) + 1, "deleted": gone, "content_hash": None if gone else m["content_hash"]}


def fold(mutations: DataFrame, policy: BucketPolicy | None = None, by_program: bool = False) -> DataFrame:
    """An outcome for every mutation (seq, command_id, path, mode, expected, content_hash), with the head it leaves."""
    policy = policy or BucketPolicy()
    told = receipts(fingerprint(mutations))
    fresh = told.filter("receipt = 'first'").select("seq", "command_id", "path", "mode", "expected", "content_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in batches:
            rows = []
            for m in batch.to_pylist():
                if m["path"] != at:
                    at, head = m["path"], None
                outcome, head = _step(head, m, policy, by_program)
                rows.append((m["seq"], m["command_id"], m["path"], outcome, *((head["version"], head["deleted"], head["content_hash"]) if head else (None, None, None))))
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=[p.split()[0] for p in OUTCOME.split(", ")])

    done = fresh.repartition("path").sortWithinPartitions("path", "seq").mapInArrow(run, OUTCOME)
    # a replay answers as the command did; a conflict changes nothing
    again = told.filter("receipt <> 'first'").select("seq", "command_id", "path", "receipt")
    old = done.select("command_id", "version", "deleted", "content_hash")
    late = again.join(old, "command_id", "left").select("seq", "command_id", "path", F.when(F.col("receipt") == "replay", "replayed").otherwise("idempotency_conflict").alias("outcome"), "version", "deleted", "content_hash")
    return done.unionByName(late)


def heads(outcomes: DataFrame) -> DataFrame:
    """The head of every path after all mutations."""
    return outcomes.filter("outcome = 'applied'").groupBy("path").agg(F.max_by(F.struct("version", "deleted", "content_hash"), "seq").alias("h")).select("path", "h.*")


def last_writer_heads(log: DataFrame, path: str = "path", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """Where every write is unconditional: the newest entry of each path is its head, and their number its version."""
    return log.groupBy(path).agg(F.count("*").alias("version"), F.max_by(deleted, seq).alias("deleted"))

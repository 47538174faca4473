"""Hash-linked changeset logs: appending, checking, catching up and mirroring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GROUP = ["db", "grp"]


def entry_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.lit("|"), payload), 256)


def verify(entries: DataFrame, keys: list[str] = GROUP, index: str = "log_index") -> DataFrame:
    """entries (keys, index, previous, hash, payload) with ``ok``: the next index, its predecessor's hash, and its own."""
    w = Window.partitionBy(*keys).orderBy(index)
    before, at = F.lag("hash").over(w), F.lag(index).over(w)
    linked = F.when(at.isNull(), F.col("previous").isNull()).otherwise((F.col(index) == at + 1) & F.col("previous").eqNullSafe(before))
    return entries.withColumn("ok", linked & (F.col("hash") == entry_hash(F.col("previous"), F.col("payload"))))


def catch_up(entries: DataFrame, after: int, hash_: str | None, most_entries: int = 1000, most_bytes: int = 4 << 20) -> DataFrame:
    """Entries of one group behind a verified place, up to both bounds (one entry at least)."""
    if after > 0 and entries.filter((F.col("log_index") == after) & (F.col("hash") == hash_)).isEmpty():
        raise ValueError("the place isn't in this log")
    ahead = entries.filter((F.col("log_index") > after) & (F.col("log_index") <= after + most_entries))
    size = F.sum(F.octet_length("payload")).over(Window.partitionBy(*GROUP).orderBy("log_index"))
    return ahead.withColumn("_bytes", size).filter((F.col("_bytes") <= most_bytes) | (F.col("log_index") == after + 1)).drop("_bytes").orderBy("log_index")


def append(entries: DataFrame, db: str, grp: str, payload: str, expected_index: int, expected_hash: str | None) -> DataFrame:
    """The log with one more entry; its predecessor must be the last one. Repeating an append changes nothing."""
    spark = entries.sparkSession
    own = entries.filter((F.col("db") == db) & (F.col("grp") == grp))
    last = own.orderBy(F.desc("log_index")).limit(2).collect()
    new = spark.createDataFrame([(db, grp, expected_index + 1, expected_hash, payload)], "db string, grp string, log_index long, previous string, payload string").withColumn("hash", entry_hash(F.col("previous"), F.col("payload")))
    if last and last[0]["log_index"] == expected_index + 1 and last[0]["previous"] == expected_hash and last[0]["payload"] == payload:
        return entries
    if (last[0]["log_index"], last[0]["hash"]) != (expected_index, expected_hash) if last else (expected_index, expected_hash) != (0, None):
        raise ValueError("the predecessor has moved on")
    return entries.unionByName(new)


def mirror(entries: DataFrame, done: DataFrame, through: int) -> DataFrame:
    """Entries to copy: verified, behind what the mirror has, up to the source's checkpoint."""
    have = done.groupBy(*GROUP).agg(F.max("log_index").alias("_have"))
    checked = verify(entries.filter(F.col("log_index") <= through))
    bad = F.when(~F.col("ok"), F.raise_error("the log is broken").cast("boolean")).otherwise(True)
    return checked.filter(bad).join(have, GROUP, "left").filter(F.col("log_index") > F.coalesce("_have", F.lit(0))).drop("_have", "ok")


ROLES = ("writer", "reader")


def create_groups(members: DataFrame) -> DataFrame:
    """Groups by their members (db, grp, member, role): a member has one role, and a group one writer at least."""
    bad = F.raise_error(F.concat(F.lit("no role "), F.col("role"))).cast("string")
    one = members.withColumn("role", F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(bad)).distinct()
    groups = one.groupBy(*GROUP, "member").agg(F.collect_set("role").alias("roles"))
    twice = F.raise_error(F.concat(F.lit("two roles for "), F.col("member"))).cast("string")
    return groups.select(*GROUP, "member", F.when(F.size("roles") == 1, F.get("roles", F.lit(0))).otherwise(twice).alias("role"))


def describe(groups: DataFrame) -> DataFrame:
    """(db, grp, members, writers, readers) of every group."""
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    return groups.groupBy(*GROUP).agg(F.count("*").alias("members"), count("writer").alias("writers"), count("reader").alias("readers"))


def list_groups(groups: DataFrame, db: str, after: str | None = None, limit: int = 1000) -> DataFrame:
    """The groups of a database in order, behind a cursor."""
    own = groups.filter(F.col("db") == db).select("grp").distinct()
    return (own if after is None else own.filter(F.col("grp") > after)).orderBy("grp").limit(limit)


def may(groups: DataFrame, db: str, grp: str, member: str, write: bool) -> bool:
    """Writers read too."""
    found = groups.filter((F.col("db") == db) & (F.col("grp") == grp) & (F.col("member") == member))
    return not (found.filter("role = 'writer'") if write else found).isEmpty()


def register_snapshots(entries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots (db, grp, log_index, hash, files) that stand at an entry of their logs; another is an error."""
    at = entries.select(*GROUP, "log_index", F.col("hash").alias("_hash"))
    joined = snapshots.join(at, [*GROUP, "log_index"], "left")
    bad = F.raise_error(F.concat(F.lit("no such entry: "), F.col("log_index").cast("string"))).cast("string")
    return joined.withColumn("hash", F.when(F.col("hash").eqNullSafe(F.col("_hash")), F.col("hash")).otherwise(bad)).drop("_hash")


def latest_snapshots(snapshots: DataFrame, through: int | None = None) -> DataFrame:
    """The newest snapshot of every group, at or before an index."""
    own = snapshots if through is None else snapshots.filter(F.col("log_index") <= through)
    return own.groupBy(*GROUP).agg(F.max_by(F.struct("log_index", "hash", "files"), "log_index").alias("s")).select(*GROUP, "s.*")

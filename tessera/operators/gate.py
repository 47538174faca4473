"""Which hits may be seen: authorised for the subject, and still the current version. Applied before top-k and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows whose source, and result, are live heads at exactly the indexed version. heads: path, version, deleted."""
    live = heads.filter(~F.col("deleted")).select("path", F.col("version").cast("decimal(20,0)").alias("version"))
    out = rows.join(live, (F.col("source_path") == F.col("path")) & (F.col("source_version") == F.col("version")), "left_semi")
    other = out.filter((F.col("result_path") != F.col("source_path")) | (F.col("result_version") != F.col("source_version")))
    same = out.filter((F.col("result_path") == F.col("source_path")) & (F.col("result_version") == F.col("source_version")))
    return same.unionByName(other.join(live, (F.col("result_path") == F.col("path")) & (F.col("result_version") == F.col("version")), "left_semi"))


def authorized(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose result path stands in ``allowed`` (path). No right follows from a prefix."""
    return rows.join(allowed.select(F.col("path").alias("_allowed")).distinct(), F.col("result_path") == F.col("_allowed"), "left_semi")

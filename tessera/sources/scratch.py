"""Tables that a query keeps for itself, in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder of this application; where no shared one is set, and only on one machine, a temporary folder."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        found = sc._jsc.sc().getCheckpointDir()
        if not found.isDefined():
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            found = sc._jsc.sc().getCheckpointDir()
        where = found.get()
    return f"{where.rstrip('/')}/tessera-{sc.applicationId}"


def folder(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, written and read again: lineage ends here, and a lost executor costs one step."""
    spark = df.sparkSession
    where = folder(spark, "step")
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)

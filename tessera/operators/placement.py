"""Weighted rendezvous placement: each key ranks the nodes by weight / -log2(hash), ties to the lower node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a SHA-256."""
    return (F.conv(F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(13)), 16, 10).cast("double") + 0.5) / float(1 << 52)


#: Most members of a cluster: every key is scored against each of them, so their list travels with the tasks.
MOST_NODES = 10_000


def rank(keys: DataFrame, nodes: DataFrame, owners: int = 3) -> DataFrame:
    """(key, rank, node) of the best nodes of each key. nodes (node, weight) is the cluster's member list, whose size is checked."""
    if nodes.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"over {MOST_NODES} nodes")
    pairs = keys.crossJoin(F.broadcast(nodes.filter("weight > 0")))
    score = F.col("weight") / -F.log2(unit_hash(F.col("key").cast("string"), F.col("node").cast("string")))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "node")
    return pairs.withColumn("score", score).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= owners).select("key", "rank", "node")

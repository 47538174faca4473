import hashlib
import math

from tessera import queries as Q


def test_every_customer_is_placed(spark, tmp_path):
    nodes = [(f"N{k}", k % 5) for k in range(12)]
    keys = [*range(1, 260), 15000]
    spark.createDataFrame(nodes, "n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    want = set()
    for key in keys:
        unit = lambda node: (int(hashlib.sha256(f"{key}|{node}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52  # noqa: B023, E731
        best = sorted(nodes, key=lambda n: ((1 + n[1]) / math.log2(unit(n[0])), n[0]))[:3]
        want |= {(key, rank, n[0]) for rank, n in enumerate(best, 1)}
    got = [tuple(r) for r in Q.QUERIES["placement_rank"](spark, str(tmp_path)).collect()]
    assert len(got) == 3 * len(keys) and {*got} == want

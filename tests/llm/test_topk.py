import random

import duckdb
import numpy as np

from tessera.llm import topk as T


def brute(rows, k=T.K, every=T.QUERY_EVERY):
    v = {i: [int(np.floor(256 * float(np.float32(x)))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scores, 1)]
    return sorted(out)


def corpus():
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1 + k % 3) for _ in range(12)]) for k in range(400)]
    rows += [(k, [0.5] * 12) for k in range(400, 460)]  # ties
    return rows + [(500, None), (550, [1.0, None]), (600, [float("nan")] * 12), (650, [float("inf")] + [0.0] * 11), (700, [0.0] * 12), (750, [1.0, -2.0]), (None, [9.0] * 12), (800, [])]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", 3) for r in corpus()], "vec_id long, embedding array<float>, rank string, score int").repartition(5)
    want = brute(corpus())
    for size, first in ((T.BLOCK_BYTES, T.PASS), (12 * 8 * 20, 3)):
        assert sorted(tuple(r) for r in T.top_k(df, block_bytes=size, first=first).collect()) == want


def test_large_components_and_few_rows(spark):
    rows = [(0, [1e30, -1e30]), (1, [3e8, 2e8]), (2, [-1e30, 5.0]), (50, [3e8, 1.0])]
    got = T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = {(q, r, c): min(max(s, -(1 << 63)), (1 << 63) - 1) for q, r, c, s in brute(rows)}
    assert {(r.query_id, r.vec_id): r.score for r in got.collect()} == {(q, c): s for (q, _, c), s in want.items()}
    assert T.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_sql_says_the_same(spark, tmp_path):
    df = spark.createDataFrame([r for r in corpus() if r[0] is not None and r[1] is not None and len(r[1]) == 12], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(tuple(r) for r in T.op5_topk(spark, str(tmp_path)).collect()) == sorted(con.sql("select query_id, rank, vec_id, score from (" + T.OP5_SQL + ")").fetchall())


def test_rows_that_repeat_count_once(spark, tmp_path):
    rows = corpus()[:60]
    more = rows + rows[:10] + [(0, [1.0] * 12), (0, [1.0] * 12)]
    df = spark.createDataFrame(more, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in T.top_k(df, block_bytes=12 * 8 * 20, first=1).collect())
    assert len(got) == 5 * 3 and [r[1] for r in got] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 1, 2, 3, 4, 5]
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql("select query_id, rank, vec_id, score from (" + T.OP5_SQL + ")").fetchall())


def test_few_blocks_are_met_where_norms_differ():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(10, 8))
    q = T.Block({"ids": np.arange(10).tobytes(), "m": m.tobytes(), "head": m.tobytes(), "rest": np.zeros(10).tobytes()}, 8)
    tops = np.array([100.0, 50.0, 20.0, 1.0])
    for t, want in ((60.0, 1), (50.0, 2), (30.0, 2), (0.5, 4), (-np.inf, 4), (101.0, 0)):
        assert T.reach(q, t * q.norm, tops) == want

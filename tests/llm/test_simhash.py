import random

import numpy as np

from tessera.llm import simhash as S


def brute(fps):
    """doc_id: fingerprint to doc_id: smallest doc_id reachable."""
    up = {d: d for d in fps}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ds = sorted(fps)
    for i, a in enumerate(ds):
        for b in ds[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= S.RADIUS:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in fps}


def test_tree_finds_all_within_radius():
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << rng.randrange(64)) for v in values] + [v ^ (3 << rng.randrange(62)) for v in values]
    values = np.array(sorted({*values}), np.uint64)
    queries = np.array([*values.tolist(), rng.getrandbits(64), 0], np.uint64)
    for tree in (S.BKTree(values), S.BKTree.unpack(S.BKTree(values).pack())):
        for r in (0, 1, 2, 3, 28, 64):
            for most in (1, 1 << 20):
                got = {(int(queries[a]), int(tree.value[b])) for q, node in tree.search(queries, r, most) for a, b in zip(q, node)}
                assert got == {(int(q), int(v)) for q in queries for v in values if (int(v) ^ int(q)).bit_count() <= r}
    assert [*S.BKTree(values[:0]).search(queries, 2)] == [] and len(S.BKTree(values[:1]).pack()) == S.NODE_BYTES


def test_hot_groups_are_dealt_anew_until_they_fit(spark):
    # 12 bits vary in one block: all agree on the other three
    values = [(0xABC << 40) | k for k in range(1 << 12)]
    placed, n = S.shards(spark.createDataFrame([(v,) for v in values], "fp long"), shard=512)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert max(sizes) <= 512 * 4 and n < len(values) * 6 * 3**3  # a shard holds whole groups, some 512 rows in all
    assert {r["fp"] for r in placed.select("fp").distinct().collect()} == {*values}
    tree = {r["node"]: r["root"] for r in S.components(S.links(spark.createDataFrame([(v,) for v in values], "fp long"), shard=512)).collect()}
    assert {*tree.values()} == {min(values)} and len(tree) == len(values)


def test_links_keep_all_components_with_small_shards(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    values = {0} | set(seeds)
    for v in seeds:
        for _ in range(12):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3))))
            values.add(v)
    as_long = lambda v: v - (1 << 64) if v >> 63 else v
    docs = {k: v for k, v in enumerate(sorted(values))}
    distinct = spark.createDataFrame([(as_long(v),) for v in values], "fp long")
    want = brute(docs)
    for shard, broadcast in ((3, 0), (3, 1 << 20), (4096, 0), (4096, 1 << 20)):
        tree = {r["node"]: r["root"] for r in S.components(S.links(distinct, shard=shard, broadcast_bytes=broadcast)).collect()}
        got = {}
        for d, v in docs.items():
            got.setdefault(tree.get(as_long(v), as_long(v)), []).append(d)
        assert {min(m): sorted(m) for m in got.values()} == {r: sorted(d for d in want if want[d] == r) for r in set(want.values())}


def test_query_matches_brute_force_and_edge_cases(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + texts[:10] + [t.upper() for t in texts[:5]] + [None, "", " \t\n", "one", "ONE", "one two", "x" * 100_000, "é è ü", "a\x0bb\x0cc\x1cd"]
    docs = spark.createDataFrame([(100 + k, t, "extra", 1) for k, t in enumerate(texts)], "doc_id long, text string, fp string, component_id int")
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in S.near_duplicates(docs).collect()}
    fps = {100 + k: S.fingerprint(t) for k, t in enumerate(texts)}
    assert fps[100 + len(texts) - 9] == 0
    want = brute(fps)
    assert got == {d: (fps[d], want[d]) for d in fps}


def test_fingerprint_by_definition():
    import xxhash

    text = "The quick Brown fox jumps over The quick Brown fox"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]), 42) for k in range(len(w) - 2)]
    assert S.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []

import random

import corpus_pipeline as P
import numpy as np
from tessera.llm import nearcopies as N
from tessera.llm.simhash import bits


def jaccard(a, b):
    x, y = ({*zip(*(t.lower().split()[k:] for k in range(5)))} for t in (a, b))
    return len(x & y) / len(x | y)


def corpus():
    """Texts, some with copies edited word by word down to a similarity just above or just under 0.8, and chains of copies."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = " ".join(word() for _ in range(60))
    docs, edge = [], []
    for k in range(30):
        base = [word() for _ in range(rng.randint(40, 700))] + (passage.split() if k % 3 == 0 else [])
        docs.append(" ".join(base))
        now, last = base[:], docs[-1]
        while jaccard(docs[-1], " ".join(now)) >= 0.8:
            last = " ".join(now)
            now[rng.randrange(len(now))] = word()
        edge.append((len(docs) - 1, len(docs)))
        docs += [last, " ".join(now)]
    chain = [word() for _ in range(200)]
    for _ in range(25):
        chain[rng.randrange(200)] = word()
        docs.append(" ".join(chain))
    return docs, edge


def roots(docs):
    up = [*range(len(docs))]
    for a in range(len(docs)):
        for b in range(a):
            if jaccard(docs[a], docs[b]) >= 0.8:
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
    return up


def test_edited_copies_match_brute_force(spark):
    docs, edge = corpus()
    assert all(0.8 <= jaccard(docs[a], docs[b]) < 0.9 for a, b in edge)
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    want = roots(docs)
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(df).collect()} == dict(enumerate(want))
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, df, "").collect()) == sorted({*want})


def test_bounds_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 4, 5, 9, 10, 63, 64, 65, 100, 127, 129, 1000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = rng.integers(0, n // 5 + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, rng.integers(0, n // 5 + 1)).astype(np.uint64)]))
            common = np.sort(rng.choice(a, n // 2, replace=False))
            times = rng.integers(2, 9, len(common))
            if N.similar(a, b):
                assert (bits(a) ^ bits(b)).bit_count() <= N.RADIUS
                assert {*N.prefix(a, common, times).tolist()} & {*N.prefix(b, common, times).tolist()}


def test_blank_equal_and_short_texts(spark):
    rows = [(1, None), (2, " "), (3, "One two"), (4, "one  TWO"), (5, "one three"), (None, "one two")]
    got = {r["doc_id"]: r["component_id"] for r in N.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_salted_shards_give_the_same_links(spark):
    from tessera.llm.common import Scratch

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    own = [np.unique(np.concatenate([base[k % 30 :], rng.integers(0, 1 << 63, k % 20).astype(np.uint64)])) for k in range(60)]
    rows = [(7, k, len(s), 0, int(np.uint64(bits(s)).view(np.int64)), k) for k, s in enumerate(own)]
    df = spark.createDataFrame(rows, "key long, sid long, n int, pos int, fp long, label long")
    want = {(a, b) for b in range(60) for a in range(b) if (bits(own[a]) ^ bits(own[b])).bit_count() <= N.RADIUS and 5 * min(len(own[a]), len(own[b])) >= 4 * max(len(own[a]), len(own[b]))}
    for shard in (7, 4096):
        got = {(r["a"], r["b"]) for r in N.in_shards(df, Scratch(spark), shard).collect()}
        assert got <= want and {p for p in want if N.similar(own[p[0]], own[p[1]])} <= got


def test_rows_with_one_id_and_different_texts(spark):
    a, b = "one two three four five six", "quite another text of some more words"
    df = spark.createDataFrame([(3, a, 1, 2), (5, a, 1, 2), (5, b, 1, 2), (5, b, 1, 2), (None, a, 1, 2)], "doc_id long, text string, doc int, hash int")
    assert sorted((str(r["doc_id"]), r["text"]) for r in P.near_duplicates(spark, df, "").collect()) == sorted([("3", a), ("5", b), ("5", b), ("None", a)])


def test_shared_keys_across_batches(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(400) if k % 3 else 1, k, k % 7) for k in range(1500)] + [(10_000 + k, k, 0) for k in range(300)]
    count = {}
    for k, *_ in rows:
        count[k] = count.get(k, 0) + 1
    got = sorted(tuple(r) for r in N.shared(spark.createDataFrame(rows, "key long, sid long, pos int")).collect())
    assert got == sorted(r for r in rows if count[r[0]] > 1) and len(got) < len(rows)


def test_parities_lose_no_similar_pair():
    rng = np.random.default_rng(6)
    for n in (0, 1, 4, 9, 63, 64, 65, 127, 129, 1000, 5000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = rng.integers(0, n // 5 + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, rng.integers(0, n // 2 + 1)).astype(np.uint64)]))
            c = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            x, y, z = map(N.parities, (a, b, c))
            assert N.apart(x, y) == N.apart(y, x) <= len(np.setxor1d(a, b)) and N.apart(x, x) == 0
            if N.similar(a, b):
                assert 9 * N.apart(x, y) <= len(a) + len(b)
            assert n < 63 or 9 * N.apart(x, z) > len(a) + len(c)


def shuffled(spark):
    """Bytes that tasks have written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    each = sc.statusStore().executorList(False)
    return sum(each.apply(k).totalShuffleWrite() for k in range(each.size()))


def test_whole_sets_travel_for_similar_pairs_only(spark):
    """Texts of passages that stand in six of them each: many pairs share a rare shingle, none is similar but the copies."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passages = [" ".join(word() for _ in range(60)) for _ in range(250)]
    dealt = passages * 6
    rng.shuffle(dealt)
    docs = [" ".join(dealt[k : k + 5]) for k in range(0, len(dealt), 5)]
    docs += [f"{d} more" for d in docs[:20]]
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    before = shuffled(spark)
    got = {r["doc_id"]: r["component_id"] for r in N.near_copies(df).collect()}
    assert got == {k: k if k < 300 else k - 300 for k in range(320)}
    assert shuffled(spark) - before < 4 * sum(map(len, docs))


def test_pivots_join_what_one_set_does_not(spark):
    """Near copies of one text, most of them too far from each other for a link: the pivots leave few sets apart, and all of their pairs may be similar."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    own = [np.unique(np.concatenate([rng.choice(base, 275, replace=False), rng.integers(0, 1 << 63, 10).astype(np.uint64)])) for _ in range(120)]
    rows = [(key, k, len(s), 0, int(np.uint64(bits(s)).view(np.int64))) for key in (7, 8) for k, s in enumerate(own)] + [(9, 1, 285, 0, 0), (9, 2, 285, 0, 0)]
    df = spark.createDataFrame(rows, "key long, sid long, n int, pos int, fp long")

    def apart(pairs):
        up = [*range(120)]
        for a, b in pairs:
            if N.similar(own[a], own[b]):
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
        return sum(u != v for k, u in enumerate(up) for v in up[:k])

    one = {(r["a"], r["b"]) for r in N.to_one(df).collect()}
    some = {(r["a"], r["b"]) for r in N.to_some(df, 100, 24).collect()}
    assert all(a < b for a, b in some) and len(some) <= 24 * 120
    assert apart(one | some) * 5 < apart(one)
    assert N.to_some(df, 120).count() == 0

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ngramlm as M


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(docs):
    """The same model with dictionaries."""
    seqs = {d: [*words(t), None] for d, t in docs.items()}
    train = {d for d in docs if zlib.crc32(str(d).encode()) % 5 != 1}
    grams = lambda seq: zip([None, None, *seq], [None, *seq], seq)
    uni, big, tri, ctx, ctx2 = (Counter() for _ in range(5))
    for d in train:
        for k, (a, b, c) in enumerate(grams(seqs[d])):
            uni[c] += 1
            big[b, c] += 1
            tri[k == 0, a, b, c] += 1
            ctx[b] += 1
            ctx2[k == 0, a, b] += 1
    total, distinct = sum(uni.values()), len(uni)
    one = lambda x: int(M._log_bin(np.array([x]), M.BINS)[0])
    at = lambda x, y: int(M.bucket(np.array([x]), np.array([y]))[0])
    hist = Counter()
    for d in train:
        for k, (a, b, c) in enumerate(grams(seqs[d])):
            n1, n2 = ctx[b] - 1, ctx2[k == 0, a, b] - 1
            p3 = (tri[k == 0, a, b, c] - 1) / n2 if n2 else 0.0
            p2 = (big[b, c] - 1) / n1 if n1 else 0.0
            hist[at(n1, n2), one(p3), one(p2), one((uni[c] - 1) / max(total - 1, 1))] += 1
    u = 1 / (distinct + 1)
    w = M.learn(np.array(sorted(hist)).reshape(-1, 4), np.array([hist[x] for x in sorted(hist)], float), u)
    out = {}
    for d, seq in seqs.items():
        base = score = 0.0
        for k, (a, b, c) in enumerate(grams(seq)):
            base += math.log10((uni[c] + 0.5) / (total + 0.5 * (distinct + 1)))
            n1, n2 = ctx[b], ctx2[k == 0, a, b]
            x = w[at(n1, n2)]
            score += math.log10(x[0] * (tri[k == 0, a, b, c] / n2 if n2 else u) + x[1] * (big[b, c] / n1 if n1 else u) + x[2] * uni[c] / max(total, 1) + x[3] * u)
        out[d] = (d not in train, len(seq), sum(uni[b] > 0 for b in seq), total, base, score)
    return out


def corpus():
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(60)] + ["É", "ß", "x\x1cy"]
    out = {k: rng.choice([" ", "\n", " \t "]).join(rng.choices(vocab, weights=range(len(vocab), 0, -1), k=rng.randint(0, 80))) for k in range(120)}
    return out | {500: None, 501: "", 502: "  \t", 503: "The THE the", 504: "zz " * 30_000, 505: out[3], 506: out[3], 507: " lead"}


@pytest.mark.parametrize("block_bytes,partitions", [(1 << 20, 3), (500, 7)])
def test_matches_brute_force(spark, monkeypatch, block_bytes, partitions):
    monkeypatch.setattr(M, "BLOCK_BYTES", block_bytes)
    docs = corpus()
    df = spark.createDataFrame([(d, t, "q", 2) for d, t in docs.items()], "doc_id long, text string, block string, part int").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in M.score(df, partitions).collect()}
    want = brute(docs)
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:4] == want[d][:4]
        assert got[d][4:] == pytest.approx(want[d][4:], rel=1e-9)


def test_model_beats_base_on_held_out_text(spark):
    rng = random.Random(3)
    docs = {k: " ".join(f"a{j} b{j}" for j in (rng.randrange(40) for _ in range(50))) for k in range(100)}
    out = M.score(spark.createDataFrame([*docs.items()], "doc_id long, text string"), 2).filter("held_out").collect()
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out) * 0.75


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "b")]
    assert len(M.score(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()) == 3
    assert M.score(spark.createDataFrame([], "doc_id long, text string"), 2).collect() == []


def test_triples_tell_what_pairs_cannot(spark):
    """The word after "x" is fixed by the one before it."""
    rng = random.Random(3)
    docs = {k: " ".join(f"a{j} x c{j}" for j in (rng.randrange(20) for _ in range(60))) for k in range(100)}
    out = [r for r in M.score(spark.createDataFrame([*docs.items()], "doc_id long, text string"), 2).collect() if r.held_out]
    assert out and all(-r.score / r.n_tokens < 0.6 for r in out)  # a pair alone: (log10 20 + 0 + log10 20) / 3 = 0.87


def test_very_many_empty_texts_are_more_than_one_block(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TEXTS", 10)
    from tessera.llm.common import Scratch

    df = spark.createDataFrame([(k, None) for k in range(100)], "doc_id long, text string").coalesce(1)
    assert M.pack(df, Scratch(spark)).count() == 10
    assert {r.n_tokens for r in M.score(df, 2).collect()} == {1}


def test_keys_grow_with_the_corpus():
    assert [M.gram_bytes(n) for n in (0, 1 << 20, 1 << 30, 1 << 40, 1 << 47, 1 << 60)] == [5, 5, 6, 8, 8, 8]
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 1000).astype(np.uint64))
    assert (M._unpack_keys(M._pack_keys(keys, 5), 5) == keys).all() and len(M._unpack_keys(M._pack_keys(keys[:0], 5), 5)) == 0

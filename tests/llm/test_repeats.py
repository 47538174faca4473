import hashlib
import random

import numpy as np
import pytest

from tessera.llm import repeats as R
from tessera.llm import suffixarray as A


def passages(docs, length, words):
    """Maximal runs covered by strings of that length that also start elsewhere, of over ``words`` words."""
    return [sum(len(part) > words for part in runs) for runs in covered(docs, length)]


def covered(docs, length):
    count = {}
    datas = [(t or "").encode() for _, t in docs]
    for b in datas:
        for x in range(len(b) - length + 1):
            count[b[x : x + length]] = count.get(b[x : x + length], 0) + 1
    for b in datas:
        runs, end = [], -1
        for x in range(len(b) - length + 1):
            if count[b[x : x + length]] > 1:
                if x <= end:
                    runs[-1][1] = x + length
                else:
                    runs.append([x, x + length])
                end = x + length
        yield [b[a:z].split() for a, z in runs]


def brute(docs, length):
    """row: (bytes, removed, runs, digest); docs: list of (id, text)."""
    count = {}
    datas = [(t or "").encode() for _, t in docs]
    for b in datas:
        for x in range(len(b) - length + 1):
            count[b[x : x + length]] = count.get(b[x : x + length], 0) + 1
    out = []
    for (i, _), b in zip(docs, datas):
        gone = np.zeros(len(b) + 1, bool)
        for x in range(len(b) - length + 1):
            if count[b[x : x + length]] > 1:
                gone[x : x + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted((tuple(r) + (n,) for r, n in zip(out, passages(docs, R.PASSAGE, R.PASSAGE_WORDS))), key=str)


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other, short = prose(160), prose(120), prose(62)[:330]
    docs = [(k, prose(rng.randint(0, 150))) for k in range(15)]
    docs += [(100 + k, prose(30) + passage + prose(30)) for k in range(14)]
    docs += [(150 + k, prose(30) + short + prose(30)) for k in range(9)] + [(160, prose(9) + short[:255]), (161, short[:300] + prose(9))]
    docs += [(200, passage[:420]), (201, other + prose(5) + other), (202, "z" * 3000), (203, "z" * 420), (204, None), (205, ""), (206, "ab" * 900), (207, docs[3][1]), (207, docs[3][1]), (208, passage[7:405]), (209, passage * 4), (None, passage + "end")]
    return docs


@pytest.mark.parametrize("base", [0, 5, A.BASE])
def test_suffix_array_and_prefixes(monkeypatch, base):
    """base 0: recursion to the end; queues and arrays go to disk in some trials."""
    monkeypatch.setattr(A, "BASE", base)
    rng = np.random.default_rng(1)
    for trial in range(150):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 80))
        t = np.append(np.tile(t, 3) if trial % 3 == 0 else t, 0).astype(np.uint16)
        limit = 1000 if trial % 2 else 6
        order, prefix = A.Sorter(t, limit, memory=30 if trial % 5 == 0 else 1 << 20).sort()
        s = t.tolist()
        assert sorted(order.tolist()) == [*range(len(s))]
        for a, b, n in zip(order, order[1:], prefix[1:]):
            assert s[a : a + limit] <= s[b : b + limit]
            k = 0
            while k < limit and max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert n == k


def test_a_production_shard_spills_and_recurs(monkeypatch):
    """A shard of the production size, at the production bound of memory: its queues don't fit, nor do its names."""
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"abcdefgh etaoin", np.uint8), R.SHARD_BYTES + 1000).tobytes()
    sorts = []
    monkeypatch.setattr(A.Sorter, "sort", lambda self, sort=A.Sorter.sort: sorts.append(len(self.text)) or sort(self))
    before = A.Spool.spilled
    texts = [(1, data[:2_000_000]), (1, data[2_000_000:]), (1, b"x" * 50 + data[777_777:778_300]), (2, b"once more" * 50), (1, b"y" * 399), (1, b"z" * 399)]
    parts = [(c, len(b) - (255 if c == 2 or b[:1] in b"xyz" else 0), b) for c, b in texts]
    want = [[(777_777, 778_300)], [], [(50, 573)], [(0, 450)], [], []]
    got = R.mark_shard(parts, (256, 400))
    assert [[s[1:] for s in own if s[0] == 400] for own in got] == want
    assert [[s[1:] for s in own if s[0] == 256] for own in got][:4] == want[:4]
    assert R.mark_shard([(1, 3, b"q" * 300), (1, 10, b"q" * 300)], (256, 400))[0] == [(256, 0, 258)]  # its own places alone
    assert A.Spool.spilled > before and len(sorts) > 1 and sorts[0] > sorts[1] > 1_000_000


def test_windows_hold_each_start_once_whatever_the_piece():
    rng = random.Random(3)
    many = ["".join(rng.choices("ab", k=rng.choice((0, 5, 399, 400, 401, 900, 5000)))).encode() for _ in range(40)] + [b"z" * 3000, b"ab" * 2000]
    raw, offsets = np.frombuffer(b"".join(many), np.uint8), np.concatenate([[0], np.cumsum([*map(len, many)])])
    starts = sorted(o + x for o, b in zip(offsets.tolist(), many) for x in range(len(b) - R.LENGTH + 1))
    data = memoryview(raw)
    by_piece = []
    for piece in (500, 2000, 1 << 20):
        got, keys = [], {}
        for a, n, place in R.windows(raw, offsets, piece=piece):
            got += [x + k for x, m in zip(a.tolist(), n.tolist()) for k in range(m)]
            h, _ = R.window_keys(data, a, n, n + R.LENGTH - 1, place)
            for k, x, m in zip(h.tolist(), a.tolist(), n.tolist()):
                keys.update((x + y, k) for y in range(m))
        assert sorted(got) == starts
        by_piece.append([keys[x] for x in starts])
    assert by_piece[0] == by_piece[1] == by_piece[2]  # a start's key follows from its string
    seen = {}
    for x, k in zip(starts, by_piece[0]):
        assert seen.setdefault(bytes(data[x : x + R.LENGTH]), k) == k


@pytest.mark.parametrize("limit", [R.WINDOWS, 3])
def test_matches_brute_force(spark, limit):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, h string, n_bytes int").repartition(4)
    got = sorted((tuple(r) for r in R.remove_repeats(df, digest=True, limit=limit).collect()), key=str)
    want = brute(docs, R.LENGTH)
    assert got == want and sum(r[2] for r in want) > 10_000 and sum(r[5] > 0 and r[2] == 0 for r in want) >= 9


def test_kept_bytes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "q" * 500 + "tail"), (2, "head" + "q" * 450)], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), r.spans) for r in R.remove_repeats(docs).collect()}
    assert got == {1: (b"tail", [[0, 500]]), 2: (b"head", [[4, 454]])}
    assert R.remove_repeats(docs.limit(0)).collect() == []

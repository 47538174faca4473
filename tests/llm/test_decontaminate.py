import random

import numpy as np

from tessera.llm import decontaminate as D


def clean(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return D.normalise(raw, np.array([0, len(raw)]))[0].tobytes().decode("utf-8", "replace").strip()


def distance(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for j, c in enumerate(pattern):
        new = [j + 1]
        for i, t in enumerate(text):
            new.append(min(row[i] + (c != t), row[i + 1] + 1, new[i] + 1))
        row = new
    return min(row)


def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[k] = rng.choice("abcdefgh")
        elif kind < 0.7:
            del out[k]
        else:
            out.insert(k, rng.choice("abcdefgh"))
    return "".join(out)


def prose(rng, n):
    return " ".join("".join(rng.choices(["the", "an", "er", "ti", "on", "re", "st"], k=rng.randint(1, 4))) for _ in range(n))


def test_matches_brute_force(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(8, 30)).capitalize() + ".") for k in range(12)] + [(50, None), (51, ""), (52, "tiny item")]
    docs, k = {}, 0
    for item, text in items[:12]:
        for n in (0, 1, 3, 6, 9, 14, 20, 40):
            docs[k] = f"{prose(rng, 15)}\n{edited(text, n, rng) if n else text.upper()}, {prose(rng, 10)}"
            k += 1
    docs |= {900: None, 901: "", 902: prose(rng, 50), 903: "x" * 50_000, 904: items[3][1], 905: prose(rng, 3000) + items[4][1] + prose(rng, 3000)}
    df = spark.createDataFrame([(*r, "a", 1) for r in docs.items()], "doc_id long, text string, item_id string, start int")
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    found = D.leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id): r.edits for r in sorted(found, key=lambda r: -r.edits)}
    want = {}
    for d, text in docs.items():
        for i, item in items[:12]:
            p, t = clean(item), clean(text or "")
            if d != 903 and len(p) >= D.LEAST and (d < 900 or d in (904, 902, 905)):
                n = distance(p, t) if len(t) < 3000 else (0 if p in t else 99)
                if n <= D.budget(len(p)):
                    want[d, i] = n
    assert got == want and len(want) > 40
    for r in found:
        part = docs[r.doc_id].encode()[r.start : r.end].decode()
        assert distance(clean(dict(items)[r.item_id]), clean(part)) <= r.edits + 1
    split = {(r.doc_id, r.item_id) for r in D.leaks(df, bench, block_bytes=400).collect()}
    assert split == set(got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a text of some length")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a text of some length that is an item")], "item_id long, text string")
    assert D.leaks(docs.limit(0), bench).collect() == [] == D.leaks(docs, bench.limit(0)).collect()


def find(items, texts, **how):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([*map(len, raw)])])
    return sorted(D.Benchmark(items).find(np.frombuffer(b"".join(raw), np.uint8), offsets, **how))


def test_half_of_a_long_item_is_no_occurrence():
    rng = random.Random(5)
    for n in (512, 513, 600, 3000):
        item = prose(rng, n)[:n].strip()
        texts = [prose(rng, 20) + " " + item[: len(item) // 2] + " " + prose(rng, 80), prose(rng, 20) + " " + item[len(item) // 2 :], f"{prose(rng, 9)} {item} {prose(rng, 9)}", prose(rng, 30) + edited(item, n // 40, rng)]
        assert {(d, i) for d, i, *_ in find([(7, item)], texts)} == {(2, 7), (3, 7)}


def test_repetitive_texts_stay_small_and_agree_with_a_plain_count():
    rng = random.Random(6)
    items = [(1, "0" * 400), (2, "ab" * 60), (3, prose(rng, 12)), (4, "0" * 100 + prose(rng, 10))]
    texts = ["0" * 399, "0" * 2000, "ab" * 59 + "cd" + "ab" * 70, prose(rng, 10) + items[2][1], "1" + "0" * 101 + items[3][1][100:], "x"]
    got = find(items, texts)
    want = {(d, i): distance(clean(t), clean(x)) for d, x in enumerate(texts) for i, t in items}
    want = {k: n for k, n in want.items() if n <= D.budget(len(clean(dict(items)[k[1]])))}
    assert {(d, i): min(e for x, y, *_, e in got if (x, y) == (d, i)) for d, i, *_ in got} == want
    # pieces and slices of any size change nothing
    index = D.Benchmark(items)
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    text, off, _ = D.normalise(raw, np.concatenate([[0], np.cumsum([*map(len, texts)])]))
    sets = [sorted(map(tuple, np.concatenate([*index.bands(text, off, chunk, slice_)]).tolist())) for chunk, slice_ in ((1 << 20, 1 << 20), (100, 1 << 20), (1 << 20, 50), (64, 7))]
    assert sets[0] == sets[1] == sets[2] == sets[3] and sets[0]


def test_a_megabyte_of_zeros_takes_bounded_memory():
    import tracemalloc

    tracemalloc.start()
    found = find([(1, "0" * 400)], ["0" * (1 << 20)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 1000 and all(e == 0 for *_, e in found) and peak < 1 << 30

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(bpe.tokenizer_file())
    t.no_truncation()
    t.no_padding()
    return t


def samples(n=400):
    rng = random.Random(2)
    parts = ["a", "Bee", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "ß", "中", "\x85", "\x1c", "​", "　", "!", "<|endoftext|>", "😀", "́", "²", "\x00", " the", "'ll", "\xa0"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)] + ["", "x " * 5000, " ", "   lead and trail  "]


def test_matches_the_library_and_decodes(spark, library):
    texts = [*samples(), None]
    docs = spark.createDataFrame([(k, t, 9, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string")
    for r in bpe.encode_texts(docs, bpe.tokenizer_file()).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False) == (texts[r.doc_id] or "")


def test_digests_and_decode(spark, library):
    docs = spark.createDataFrame(list(enumerate(samples(50))), "doc_id long, text string")
    plain = {r.doc_id: r for r in bpe.encode_texts(docs, bpe.tokenizer_file()).collect()}
    for r in bpe.encode_texts(docs, bpe.tokenizer_file(), digest=True).collect():
        ids = plain[r.doc_id].ids
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain[r.doc_id].decoded.encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(docs, bpe.tokenizer_file()), bpe.tokenizer_file())
    assert {r.doc_id: r.decoded for r in back.collect()} == {k: v.decoded for k, v in plain.items()}


def test_blocks_and_parts_of_any_size_give_the_same(spark, library, monkeypatch):
    texts = [*samples(120), "<|endoftext|>" * 3, " <|endoftext|>x", "x" * 50_000]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "no id")], "doc_id long, text string").repartition(3)
    for size, many, parts in ((1, 10, 1), (200, 5, 30), (1 << 20, 1000, 7)):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", size)
        monkeypatch.setattr(bpe, "BLOCK_TEXTS", many)
        got = [(r.doc_id, r.ids) for r in bpe.encode_texts(docs, bpe.tokenizer_file(), parts=parts).collect()]
        want = [(k, library.encode(t, add_special_tokens=False).ids) for k, t in [*enumerate(texts), (0, texts[0]), (None, "no id")]]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_each_distinct_word_is_encoded_once(spark, tmp_path, monkeypatch):
    """Two blocks share all their words: the table has each of them in one part."""
    from tessera.llm.common import Scratch

    monkeypatch.setattr(bpe, "BLOCK_TEXTS", 1)
    docs = spark.createDataFrame([(k, "the same words again, the same") for k in range(4)], "doc_id long, text string").repartition(2)
    blocks, asked = bpe.split_words(docs, bpe.tokenizer_file(), 5, Scratch(spark))
    split = asked.collect()
    assert blocks.count() == len({r.block for r in split}) == 4
    by_word = {}
    for r in split:
        for w in bpe._words_opened(bytes(r.words)):
            by_word.setdefault(w, set()).add(r.part)
    assert by_word.keys() >= {b"the", b" same", b" words"}
    for many in ([b"a"], [b"a\n", b"", b" b"], [b"x" * 300, "é".encode()]):
        assert bpe._words_opened(bpe._words_packed(many)) == many
    assert all(len(p) == 1 for p in by_word.values())


def test_places_round_trip():
    rng = random.Random(6)
    for n in (0, 1, 50, 3000):
        words = [rng.randrange(1 + n // 3) for _ in range(n)]
        first = {w: k for k, w in enumerate(dict.fromkeys(words))}
        places = np.array([first[w] for w in words], np.uint32)
        assert (bpe._placed(bpe._opened(bpe._packed(bpe._referred(places)))) == places).all()


def test_empty_table(spark):
    assert bpe.encode_texts(spark.createDataFrame([], "doc_id long, text string"), bpe.tokenizer_file()).collect() == []


def test_room_of_each_step(spark, tmp_path, monkeypatch):
    """A block of 6 MB with 200,000 distinct words: no step holds over 15 times the text, vocabulary included (the last one held 45 times)."""
    real, at = bpe.map_batches, str(tmp_path)

    def measured(df, fn, schema):
        step = len(list(tmp_path.iterdir()))
        (tmp_path / f"{step}").mkdir()

        def run(batches):
            import os
            import tracemalloc

            tracemalloc.start()
            yield from fn(batches)
            with open(f"{at}/{step}/{os.urandom(8).hex()}", "w") as f:
                f.write(str(tracemalloc.get_traced_memory()[1]))
            tracemalloc.stop()

        return real(df, run, schema)

    monkeypatch.setattr(bpe, "map_batches", measured)
    bpe.of_tokenizer.cache_clear()
    rng = random.Random(8)
    some = [f"{rng.randrange(1 << 32):x}" for _ in range(200_000)]
    texts = [" ".join(rng.choices(some, k=1700)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.decoded for r in bpe.encode_texts(docs, bpe.tokenizer_file(), parts=1).collect()} == dict(enumerate(texts))
    peak = {int(p.name): max(int(f.read_text()) for f in p.iterdir()) for p in tmp_path.iterdir()}
    assert sorted(peak) == [0, 1, 2] and max(peak.values()) < 15 * sum(map(len, texts)), peak


def test_decoding_goes_a_slice_at_a_time(library):
    import tracemalloc

    words = bpe.of_tokenizer(bpe.tokenizer_file())
    ids = np.array(library.encode(" international" * 3).ids * (1 << 18), np.uint32)
    tracemalloc.start()
    raw, width = words.decode(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert raw.tobytes() == b" international" * (3 << 18) and width.sum() == len(raw)
    assert peak < 6 * len(raw)


def test_slices_of_any_size_give_the_same(spark, library, monkeypatch):
    rng = random.Random(9)
    size = np.array([rng.choice([0, 0, 1, 3]) for _ in range(50)])
    offsets, values = np.concatenate([[0], np.cumsum(size)]), np.arange(size.sum(), dtype=np.uint32)
    texts = samples(60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for step in (1, 7, 1000):
        monkeypatch.setattr(bpe, "STEP", step)
        for n in (0, 1, 7, 14, 90):
            rows = np.array([rng.randrange(50) for _ in range(n)], np.uint32)
            got, sizes = bpe.gather(offsets, values, rows)
            assert got.tolist() == [v for r in rows.tolist() for v in range(offsets[r], offsets[r + 1])] and sizes.tolist() == size[rows].tolist()
        got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_texts(docs, bpe.tokenizer_file()).collect()}
        assert got == {k: (library.encode(t, add_special_tokens=False).ids, t) for k, t in enumerate(texts)}

import random

import pytest

import corpus_pipeline as P
from tessera.llm import bpe, decontaminate, langid, linededup, simhash


def corpus():
    rng = random.Random(12)
    pools = {"aa": ["the", "ing", "and", "th", "er"], "bb": ["sch", "ung", "der", "ich", "ö"]}
    word = lambda lang: "".join(rng.choices(pools[lang], k=rng.randint(1, 4)))
    line = lambda lang, n=12: " ".join(word(lang) for _ in range(n))
    bench = [(k, line("aa", 25)) for k in range(4)]
    docs = [(k, "\n".join(line(lang) for _ in range(rng.randint(1, 8))), lang, "s", 5) for k in range(120) for lang in [rng.choice(["aa", "bb"])]]
    docs += [(200 + k, docs[k][1], docs[k][2], "s", 5) for k in range(10)]
    docs += [(300 + k, f"{line('aa')}\n{bench[k][1]} {line('aa')}", "aa", "s", 5) for k in range(4)]
    docs += [(400, None, "aa", "s", 5), (401, "", None, "s", 5), (402, "1234 !!", "bb", None, None), (403, line("bb", 9000), None, None, 5)]
    return docs, bench


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs, bench = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, docs, bench


def test_stages_keep_columns_and_match_brute_force(spark, data):
    at, docs, bench = data
    now = spark.read.parquet(f"{at}/documents.parquet")
    schema = now.schema
    rows = {d[0]: d[1] for d in docs}
    model = langid.train(now)
    for name, stage in P.STAGES:
        out = stage(spark, now, at)
        got = {r["doc_id"]: r for r in out.collect()}
        if name == "language":
            lang, score = model.predict(list(rows.values()))
            want = {d: t for (d, t), x, s in zip(rows.items(), lang, score) if x != "und" and s >= P.LEAST_SCORE}
            assert not {400, 401, 402} & want.keys() and len(want) >= 130
        elif name == "lines":
            from test_linededup import brute

            gone = brute(rows)
            want = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d]) for d, t in rows.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        elif name == "near_duplicates":
            from test_simhash import brute

            root = brute({d: simhash.fingerprint(t) for d, t in rows.items()})
            want = {d: t for d, t in rows.items() if root[d] == d}
        elif name == "decontaminated":
            from test_decontaminate import clean

            want = {d: t for d, t in rows.items() if not any(clean(b) in clean(t) for _, b in bench)}
            assert len(want) == len(rows) - 4
        else:
            assert {d: r["decoded"] for d, r in got.items()} == rows
            from tokenizers import Tokenizer

            library = Tokenizer.from_str(bpe.tokenizer_file())
            assert all(r["ids"] == library.encode(rows[d], add_special_tokens=False).ids for d, r in got.items())
            break
        assert out.schema == schema or [f.name for f in out.schema] == [f.name for f in schema]
        assert {d: r["text"] for d, r in got.items()} == want
        now, rows = spark.createDataFrame(out.collect(), schema), want
    assert {r["doc_id"]: r["ids"] for r in P.run(spark, at).collect()} == {d: r["ids"] for d, r in got.items()}


def test_empty_table_and_extra_columns(spark, data):
    at, docs, _ = data
    empty = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, at).collect() == []
    few = spark.createDataFrame([(1, "a short text of words", "aa", "ids", 3), (1, "a short text of words", "aa", "ids", 3), (None, None, None, None, None)], "doc_id long, text string, lang string, ids string, fp long")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, few, at).columns == few.columns

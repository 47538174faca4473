import hashlib
import random

import duckdb
import pytest

from tessera.llm import linededup as D


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(docs):
    """doc_id: places of removed lines."""
    first = {}
    lines = [(d, p, line) for d in sorted(docs) for p, line in enumerate((docs[d] or "").split("\n")) if line.strip()]
    for d, p, line in lines:
        first.setdefault(line, (d, p))
    gone = {d: [] for d in docs}
    for d, p, line in lines:
        if first[line] != (d, p) or len(line) >= D.LEAST and any(len(x) >= D.LEAST and f < (d, p) and near(x, line) for x, f in first.items()):
            gone[d].append(p)
    return gone


def corpus():
    rng = random.Random(11)
    words = ["the", "ing", "über", "ñ", "ation", "é", "of", "data"]
    pool = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]

    def line():
        x = rng.choice(pool)
        if rng.random() < 0.5 and x:
            k = rng.randrange(len(x))
            x = rng.choice([x[:k] + x[k + 1 :], x[:k] + rng.choice("xyé ") + x[k + 1 :], x[:k] + rng.choice("xyz") + x[k:], x + "!", "-" + x])
        return x

    docs = {k: "\n".join(line() if rng.random() < 0.9 else rng.choice(["", "  ", "}", "ok"]) for _ in range(rng.randint(1, 12))) for k in range(80)}
    return docs | {900: None, 901: "", 902: "\n\n", 903: "q" * 5000, 904: "q" * 5001, 905: docs[3], 906: "tail\n"}


@pytest.fixture(scope="module")
def removed(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "k", 5) for d, t in docs.items()], "doc_id long, text string, key string, pos int").repartition(3)
    return docs, df


def test_matches_brute_force(removed):
    docs, df = removed
    got = {r.doc_id: r for r in D.removed_lines(df).collect()}
    want = brute(docs)
    assert {d: sorted(r.removed) for d, r in got.items()} == want
    assert sum(map(len, want.values())) > 150
    assert all(r.n_lines == (len(docs[d].split("\n")) if docs[d] is not None else 0) for d, r in got.items())


def test_texts_keep_the_rest(removed):
    docs, df = removed
    want = brute(docs)
    for r in D.dedup_lines(df).collect():
        t = docs[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[r.doc_id]))
        assert (r.key, r.pos) == ("k", 5)


def test_sql_says_the_same(spark, tmp_path, removed):
    docs, df = removed
    df.filter("text is not null").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql("select doc_id, n_lines, n_removed, removed from (" + D.OP6_SQL + ")").fetchall())
    assert sorted(tuple(r) for r in D.op6_lines(spark, str(tmp_path)).collect()) == want


def test_edge_tables(spark):
    schema = "doc_id long, text string"
    assert D.dedup_lines(spark.createDataFrame([], schema)).collect() == []
    rows = spark.createDataFrame([(1, "one line that is long enough"), (1, "one line that is long enough"), (None, "one line that is long enough"), (2, "one line that is long enough")], schema)
    assert sorted((str(r.doc_id), r.text) for r in D.dedup_lines(rows).collect()) == sorted([("1", "one line that is long enough")] * 2 + [("None", "one line that is long enough"), ("2", "")])


def test_rows_with_one_id_and_different_texts(spark):
    schema = "doc_id long, text string, _doc long, _kept string, doc long, kept string, lines long, hash long"
    rows = [(5, t, 1, "x", 2, "y", 3, 4) for t in ("alpha line of some length", "beta line of some length", "first of two lines here\nsecond of two lines here", "", None)]
    df = spark.createDataFrame(rows, schema)
    got = D.dedup_lines(df).collect()
    assert sorted(str(r.text) for r in got) == sorted(str(r[1]) for r in rows) and all(tuple(r)[2:] == (1, "x", 2, "y", 3, 4) for r in got)
    assert sorted((r.n_lines, r.removed) for r in D.removed_lines(df).collect()) == [(0, []), (1, []), (1, []), (1, []), (2, [])]
    same = spark.createDataFrame([(5, "shared line of some length\nown line of the first"), (5, "shared line of some length\nown part of the second one")], "doc_id long, text string")
    assert sorted(r.text.count("shared") for r in D.dedup_lines(same).collect()) == [0, 1]


def test_a_text_of_very_many_lines_takes_linear_work(spark):
    many = "\n".join(f"{hashlib.md5(b'%d' % k).hexdigest()} of a long table" for k in range(100_000))
    df = spark.createDataFrame([(1, many), (2, many + "\nand one more line at the end")], "doc_id long, text string")
    got = {r.doc_id: r for r in D.removed_lines(df).collect()}
    assert got[2].n_lines == 100_001 and got[2].n_removed == 100_000

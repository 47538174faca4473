"""Golden cases of the index kinds: fixed objects, fixed answers, before and after an update, a delete and a rebuild."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import compute
from tessera.operators.predicate import All, Compare, Equal, Exists, FullText, In, Not, Or, Phrase, Prefix, Range, compile_predicate, decode_literal
from tessera.operators.search import IndexQuery, search
from tessera.plans import schema as S
from tessera.plans.project import project
from tessera.streaming.generation import Generations

C = S.Capability
NUMBER = (C.EXACT, C.RANGE, C.ORDER, C.FACET, C.AGGREGATE)
TYPED = S.TypedJsonIndex(
    "typed",
    S.Scope("docs", "application/json"),
    declared=(
        S.keyword("status", C.EXACT, C.PREFIX, C.RANGE, C.FACET, source="/status"),
        S.signed("modified_at", *NUMBER, source="/modified_at"),
        S.keyword("source_record_id", C.EXACT, C.PREFIX, C.RANGE, C.ORDER, C.FACET, source="/source_record_id"),
        S.unsigned("sequence", C.EXACT, C.RANGE, C.FACET, C.AGGREGATE, source="/sequence"),
        S.double("score", *NUMBER, source="/score"),
        S.boolean("enabled", C.EXACT, C.FACET, source="/enabled"),
        S.keyword("labels", C.EXACT, C.FACET, source="/labels", multi=True),
        S.signed("measurements", C.FACET, C.AGGREGATE, source="/measurements", multi=True),
        S.text("summary", source="/summary"),
    ),
    physical_order=(("modified_at", True), ("source_record_id", False)),
)
ROWS = {
    "active-a": ("active", 100, "b", 1, 1.5, True, ["stable", "stable", "alpha"], [1, 1], "durable journal alpha"),
    "inactive": ("inactive", 400, "x", 4, 9.0, False, ["archived"], [9], "unrelated material"),
    "active-b": ("active", 200, "z", 2, 2.5, True, ["stable", "beta"], [2, 3], "durable journal beta"),
    "active-c": ("active", 200, "a", 3, 3.5, True, ["stable", "gamma"], [4], "durable journal gamma"),
}
NAMES = [f.name for f in TYPED.fields]
OBJECT = "path string, version decimal(20,0), content_type string, deleted boolean, payload string"


def objects(spark, payloads, version=1, deleted=()):
    rows = [(p, Decimal(version), "application/json", p in deleted, json.dumps(x) if not isinstance(x, str) else x) for p, x in payloads.items()]
    return spark.createDataFrame(rows, OBJECT)


@pytest.fixture(scope="module")
def typed(spark):
    return project(TYPED, objects(spark, {f"docs/{k}.json": dict(zip(NAMES, v)) for k, v in ROWS.items()})).cache()


def short(rows):
    return [{"active-a": "a", "active-b": "b", "active-c": "c", "inactive": "i"}[r["path"].split("/")[1][:-5]] for r in rows]


@pytest.mark.parametrize(
    "where,want",
    [
        (Equal("status", "active"), "cba"),
        (Prefix("status", "act"), "cba"),
        (Equal("labels", "stable"), "cba"),
        (FullText("summary", "Durable"), "cba"),
        (Phrase("summary", "durable journal"), "cba"),
        (Phrase("summary", "journal durable"), ""),
        (In("source_record_id", ("a", "z")), "cb"),
        (Compare("source_record_id", "<", "x"), "ca"),
        (Equal("modified_at", 100), "a"),
        (Compare("modified_at", ">=", 200), "icb"),
        (Compare("score", ">=", 2.5), "icb"),
        (Equal("sequence", 2), "b"),
        (Equal("enabled", False), "i"),
        (Exists("measurements"), "icba"),
        (Not(Equal("labels", "stable")), "i"),
        (Or((Equal("sequence", 1), Equal("sequence", 4))), "ia"),
        (Range("score", 1.5, 3.5), "ba"),
    ],
)
def test_typed_predicates(typed, where, want):
    assert "".join(short(search(TYPED, typed, IndexQuery(where=where)).hits.collect())) == want


def test_typed_facets_and_aggregates(typed):
    facets = tuple(compute.Facet(n) for n in ("status", "source_record_id", "modified_at", "sequence", "score", "enabled", "labels", "measurements"))
    wanted = tuple(compute.Aggregate(n, op) for n in ("modified_at", "sequence", "score", "measurements") for op in compute.OPS)
    out = search(TYPED, typed, IndexQuery(where=Equal("status", "active"), facets=facets, aggregates=wanted, limit=1))
    got = {n: {r["json"]: r["count"] for r in df.collect()} for n, df in out.facets.items()}
    assert got["status"] == {'"active"': 3} and got["source_record_id"] == {'"a"': 1, '"b"': 1, '"z"': 1}
    assert got["modified_at"] == {"200": 2, "100": 1} and got["sequence"] == {"1": 1, "2": 1, "3": 1}
    assert got["score"] == {"1.5": 1, "2.5": 1, "3.5": 1} and got["enabled"] == {"true": 3}
    assert got["labels"] == {'"stable"': 3, '"alpha"': 1, '"beta"': 1, '"gamma"': 1} and got["measurements"] == {"1": 1, "2": 1, "3": 1, "4": 1}
    a = out.aggregates.first()
    for n, row in {"modified_at": (3, 100, 200, 500, 500 / 3), "sequence": (3, 1, 3, 6, 2), "score": (3, 1.5, 3.5, 7.5, 2.5), "measurements": (5, 1, 4, 11, 2.2)}.items():
        assert tuple(float(a[f"{op}_{n}"]) for op in compute.OPS) == pytest.approx(tuple(map(float, row)))
        assert a[f"contributing_{n}"] == row[0]


def test_empty_results(typed):
    out = search(TYPED, typed, IndexQuery(where=Equal("status", "none"), facets=(compute.Facet("status"),), aggregates=(compute.Aggregate("score", "count"), compute.Aggregate("score", "sum"))))
    assert out.facets["status"].collect() == [] and tuple(out.aggregates.first())[:2] == (0, None)


def test_pages_neither_repeat_nor_omit(typed):
    whole = short(search(TYPED, typed, IndexQuery()).hits.collect())
    seen, cursor = [], None
    for _ in range(10):
        page = search(TYPED, typed, IndexQuery(limit=1), cursor=cursor)
        seen += short(page.hits.collect())
        cursor = page.next_cursor()
        if cursor is None:
            break
    assert seen == whole == list("icba")


def test_cells_keep_missing_null_and_empty_apart(spark):
    spec = S.TypedJsonIndex("cells", declared=(S.signed("n", *NUMBER, source="/n"), S.keyword("tags", C.EXACT, C.FACET, source="/tags", multi=True)))
    docs = {"a": {}, "b": {"n": None, "tags": None}, "c": {"n": 1, "tags": []}, "d": {"n": 5, "tags": ["y", "x", "y", None]}, "e": {"n": {"o": 1}, "tags": [["deep"]]}, "f": "not json", "g": {"tags": "one"}}
    rows = project(spec, objects(spark, docs))
    cell = {r["source_path"]: (r["n__present"], r["n"], r["tags__present"], r["tags__null"], r["tags"]) for r in rows.collect()}
    assert cell == {"a": (False, None, False, False, None), "b": (True, None, True, True, []), "c": (True, 1, True, False, []), "d": (True, 5, True, True, ["x", "y"]), "e": (False, None, False, False, None), "g": (False, None, True, False, ["one"])}
    paths = lambda p: {r["source_path"] for r in rows.filter(compile_predicate(p, spec)).collect()}
    assert paths(Equal("n", None)) == {"b"} and paths(Exists("tags")) == {"b", "c", "d", "g"} and paths(Equal("tags", None)) == {"b", "d"}
    assert paths(Not(Compare("n", ">", 1))) == {"a", "b", "c", "e", "g"} and paths(All()) == set("abcdeg")
    up = [r["path"] for r in search(spec, rows, IndexQuery(order=(("n", False),))).hits.collect()]
    down = [r["path"] for r in search(spec, rows, IndexQuery(order=(("n", True),))).hits.collect()]
    assert up == ["b", "c", "d", "a", "e", "g"] and down == ["a", "e", "g", "d", "c", "b"]


@pytest.mark.parametrize("value", ["text", 1.5, [1], 1 << 63, True])
def test_values_of_another_type_break_the_definition(spark, value):
    spec = S.TypedJsonIndex("strict", declared=(S.signed("n", C.EXACT, source="/n"),))
    with pytest.raises(Exception, match="field n"):
        project(spec, objects(spark, {"a": {"n": value}})).collect()


def test_numbers(spark):
    spec = S.TypedJsonIndex("numbers", declared=(S.unsigned("u", C.EXACT, C.AGGREGATE, source="/u"), S.double("f", C.EXACT, source="/f")))
    rows = project(spec, objects(spark, {"a": '{"u": 18446744073709551615, "f": 2}', "b": '{"u": 0, "f": 2.5}'}))
    assert {r["source_path"]: (int(r["u"]), r["f"]) for r in rows.collect()} == {"a": (2**64 - 1, 2.0), "b": (0, 2.5)}
    with pytest.raises(Exception, match="field"):
        project(spec, objects(spark, {"a": '{"f": 9007199254740993}'})).collect()
    two = rows.unionByName(rows)
    with pytest.raises(Exception, match="out of range"):
        search(spec, two, IndexQuery(aggregates=(compute.Aggregate("u", "sum"),))).aggregates.collect()


def test_definitions_and_queries_are_checked(typed):
    for bad in (lambda: S.keyword("k", C.AGGREGATE), lambda: S.text("t", multi=True) and S.Field("t", S.FieldType.TEXT, (C.EXACT,)), lambda: S.signed("n", C.EXACT, C.EXACT), lambda: S.keyword("k", C.ORDER, multi=True), lambda: S.VectorIndex("v").validate(), lambda: S.keyword("", C.EXACT)):
        with pytest.raises(S.DefinitionError):
            bad()
    for q in (IndexQuery(where=Prefix("modified_at", "1")), IndexQuery(where=Equal("status", 1)), IndexQuery(order=(("status", False),)), IndexQuery(limit=1001), IndexQuery(text="x"), IndexQuery(where=Equal("no such", 1)), IndexQuery(where=In("status", ())), IndexQuery(facets=(compute.Facet("summary"),))):
        with pytest.raises(S.QueryError):
            search(TYPED, typed, q)
    assert decode_literal(TYPED.field("score"), "2") == 2.0 and decode_literal(TYPED.field("status"), "null") is None
    with pytest.raises(S.QueryError):
        decode_literal(TYPED.field("score"), "9007199254740993")


TEXT = S.FullTextIndex("text", declared=(S.text("body", source="/body"),))
VECTOR = S.VectorIndex("vector", source="/embedding", dims=3, normalize=True)
HYBRID = S.HybridIndex("hybrid", source="/embedding", dims=3, normalize=True, declared=(S.text("title", source="/title"),))
DOCS = {"docs/rust.json": {"title": "rust search", "embedding": [1, 0, 0]}, "docs/storage.json": {"title": "durable storage", "embedding": [0.8, 0.2, 0]}, "docs/music.json": {"title": "music library", "embedding": [0, 0, 1]}}


def paths_of(df):
    return [r["path"].split("/")[-1].split(".")[0] for r in df.collect()]


def test_full_text_vector_and_hybrid(spark):
    rows = project(TEXT, objects(spark, {"docs/a.json": {"body": "durable journal delivery"}, "docs/unrelated.json": {"body": "another subject"}, "docs/b.json": {"body": "a durable journal"}, "docs/none.json": {"body": None}}))
    assert sorted(paths_of(search(TEXT, rows, IndexQuery(text="durable journal", phrase=True)).hits)) == ["a", "b"]
    assert rows.count() == 3
    own = objects(spark, DOCS | {"docs/bad.json": {"title": "x", "embedding": [1, 2]}, "docs/zero.json": {"title": "x", "embedding": [0, 0, 0]}})
    v = project(VECTOR, own)
    out = search(VECTOR, v, IndexQuery(vector=(3.0, 0.0, 0.0)))
    assert paths_of(out.hits) == ["rust", "storage", "music"] and out.hits.first()["score"] == 1.0
    h = project(HYBRID, own)
    assert paths_of(search(HYBRID, h, IndexQuery(text="rust search", vector=(1.0, 0.0, 0.0))).hits) == ["rust"]
    assert paths_of(search(HYBRID, h, IndexQuery(text="rust search", vector=(1.0, 0.0, 0.0), fusion="union")).hits) == ["rust", "storage", "music"]
    with pytest.raises(S.QueryError):
        search(VECTOR, v, IndexQuery(vector=(0.0, 0.0, 0.0)))


def test_bm25_uses_statistics_of_all_rows(spark):
    body = {"high": "hello " * 3 + "word " * 97, "short": "hello", "other": "other " * 1000}
    rows = project(TEXT, objects(spark, {f"{k}": {"body": t} for k, t in body.items()}))
    got = search(TEXT, rows, IndexQuery(text="hello")).hits.collect()
    assert [r["path"] for r in got] == ["high", "short"]
    twice = search(TEXT, rows, IndexQuery(text="hello hello")).hits.collect()
    assert twice[0]["score"] == pytest.approx(2 * got[0]["score"], rel=1e-6)


def test_manifests(spark):
    record = lambda c, p, pack, v=1: {"repository_id": "r", "commit_id": c, "tree_path": p, "object_id": "o", "pack_path": pack, "pack_version": v, "offset": 0, "length": 9}
    git = S.GitIndex("git", repository="r")
    rows = project(git, objects(spark, {"m/1": [record("c", "src/lib.rs", "packs/1"), record("c", "README.md", "packs/1")], "m/2": record("c", "src/main.rs", "packs/2"), "m/3": [record("c", "src/x", "packs/3")] * 2, "m/4": record("c", "src/zero", "packs/4", 0)}))
    assert [r["path"] for r in search(git, rows, IndexQuery(commit="c", prefix="src/")).hits.collect()] == ["packs/1", "packs/2"]
    tensor = S.TensorIndex("t", model="m")
    one = lambda n, p: {"model_id": "m", "tensor_name": n, "source_path": p, "source_version": 2, "offset": 0, "length": 4, "dtype": "f32", "shape": [2, 2]}
    rows = project(tensor, objects(spark, {"t/1": [one("encoder.weight", "blobs/e"), one("decoder.weight", "blobs/d")]}))
    assert [(r["path"], int(r["version"])) for r in search(tensor, rows, IndexQuery(tensor="encoder.weight")).hits.collect()] == [("blobs/e", 2)]


def test_scope(spark):
    spec = S.PathIndex("p", S.Scope("docs/a"))
    rows = project(spec, objects(spark, {p: {} for p in ("docs/a", "docs/a/b", "docs/ab", "docs/a/_system/x", "other")}))
    assert sorted(r["path"] for r in rows.collect()) == ["docs/a", "docs/a/b"]
    typed = S.PathIndex("p", S.Scope("docs/a", "text/plain"))
    assert project(typed, objects(spark, {"docs/a": {}})).collect() == []


def test_generations_are_the_same_built_at_once_or_by_batches(spark, tmp_path):
    v1 = {f"docs/{k}.json": dict(zip(NAMES, v)) for k, v in ROWS.items()}
    heads = objects(spark, v1)
    g = Generations(spark, TYPED, str(tmp_path / "g"))
    assert g.current() is None
    g.build(heads)
    new = v1 | {"docs/active-a.json": v1["docs/active-a.json"] | {"status": "inactive", "modified_at": 900}, "docs/new.json": v1["docs/active-c.json"]}
    later = objects(spark, new, 2, deleted=("docs/active-b.json",))
    changed = spark.createDataFrame([("docs/active-a.json",), ("docs/active-b.json",), ("docs/new.json",), ("docs/never.json",)], "path string")
    now = later.filter(F.col("path").isin(*[r[0] for r in changed.collect()])).unionByName(heads.filter(~F.col("path").isin(*[r[0] for r in changed.collect()])))
    m = g.apply(changed, now, {"s": 7}, batch=0)
    assert g.apply(changed, now, {"s": 7}, batch=0).generation == m.generation
    q = IndexQuery(where=Compare("modified_at", ">=", 100), facets=(compute.Facet("status"),))

    def answer(rows):
        out = search(TYPED, rows, q)
        return [tuple(r) for r in out.hits.collect()], sorted(tuple(r) for r in out.facets["status"].collect())

    want = answer(project(TYPED, now))
    assert answer(g.rows()) == want and len(want[0]) == 4
    c = g.compact(everything=True)
    assert len(c.segments) == 1 and answer(g.rows()) == want and answer(g.rows(m.generation)) == want
    full = Generations(spark, TYPED, str(tmp_path / "f"))
    full.build(now)
    assert answer(full.rows()) == want
    assert g.vacuum(keep=1, seconds=0) and answer(g.rows()) == want
    other = Generations(spark, S.TypedJsonIndex("typed", declared=TYPED.declared[:3]), str(tmp_path / "g"))
    assert other.current() is None

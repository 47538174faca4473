"""Store, journal, accounting, permissions, programs, change logs, normalisation, catalog and page tokens."""

import io
import json
import random
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import analysis, paths, vectors
from tessera.operators import authz, changelog, normalize, order, placement, program, store
from tessera.plans import schema as S
from tessera.plans.catalog import Catalog
from tessera.plans.project import pointer_path
from tessera.sources import objects
from tessera.streaming import accounting, journal

MUTATION = "seq long, command_id string, path string, mode string, expected long, content_hash string"


def test_mutation_fold(spark):
    rows = [
        (1, "a", "x", "put", None, "h1"), (2, "b", "x", "put_if_absent", None, "h2"), (3, "c", "x", "put_if_version", 1, "h3"), (4, "d", "x", "delete_if_version", 1, None), (5, "e", "x", "delete", None, None),
        (6, "f", "x", "put_if_absent", None, "h4"), (7, "a", "x", "put", None, "h1"), (8, "a", "x", "put", None, "other"), (9, "g", "frozen/1", "put_immutable", None, "i1"), (10, "h", "frozen/1", "put_immutable", None, "i1"),
        (11, "i", "frozen/1", "put_immutable", None, "i2"), (12, "j", "frozen/1", "put", None, "i1"), (13, "k", "y", "put_immutable", None, "i1"), (14, "l", "prog/z", "put", None, "p"), (15, "m", "y", "delete", None, None), (16, None, "y", "put", None, "q"),
    ]
    policy = store.BucketPolicy(("frozen",), ("prog",))
    out = store.fold(spark.createDataFrame(rows, MUTATION).repartition(4), policy)
    got = {r["seq"]: (r["outcome"], r["version"]) for r in out.collect()}
    assert got == {
        1: ("applied", 1), 2: ("precondition_failed", 1), 3: ("applied", 2), 4: ("precondition_failed", 2), 5: ("applied", 3), 6: ("applied", 4), 7: ("replayed", 1), 8: ("idempotency_conflict", 1), 9: ("applied", 1),
        10: ("replayed", 1), 11: ("immutable", 1), 12: ("immutable", 1), 13: ("immutable_policy_required", None), 14: ("program_only", None), 15: ("not_found", None), 16: ("applied", 1),
    }
    assert {(r["path"], r["version"], r["deleted"]) for r in store.heads(out).collect()} == {("x", 4, False), ("frozen/1", 1, False), ("y", 1, False)}
    with pytest.raises(ValueError):
        store.BucketPolicy(("a",), ("a/b",))


def test_heads_lists_and_reads(spark):
    versions = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b/1", 1, False), ("b/2", 5, False), ("b2", 1, False)], "path string, version long, deleted boolean")
    heads = objects.current_heads(versions)
    assert [r["path"] for r in objects.list_objects(heads, "b/").collect()] == ["b/1", "b/2"]
    assert [r["path"] for r in objects.list_objects(heads, "b", "b/1", 1).collect()] == ["b/2", "b2"]
    assert {p: objects.point_read(spark, heads, p).first()["state"] for p in ("a", "b2", "zzz")} == {"a": "deleted", "b2": "present", "zzz": "never"}
    assert [(r["ordinal"], r["found"]) for r in objects.batch_get(spark, heads, ["b2", "a", "b2"]).collect()] == [(0, True), (1, False), (2, True)]
    assert [r["version"] for r in objects.history(versions, "a").collect()] == [1, 2]
    with pytest.raises(Exception, match="two sources own"):
        objects.merge_sources([heads, heads]).collect()


def test_paths(spark):
    df = spark.createDataFrame([("a/b",), ("/a",), ("a//b",), ("a/../b",), ("a/.",), ("",), ("a\tb",), ("é/ü",), ("x" * 4097,)], "path string")
    assert [r[0] for r in df.select(paths.canonical(F.col("path"))).collect()] == [True, False, False, False, False, False, False, True, False]
    row = df.select(paths.prefixes(F.lit("a/b/c")).alias("p")).first()
    assert row["p"] == ["", "a", "a/b", "a/b/c"]
    at = lambda path, prefix: spark.range(1).select(paths.in_scope(F.lit(path), prefix)).first()[0]
    assert at("docs/a", "docs") and at("docs", "docs") and not at("docsx", "docs") and at("docs/x", "docs/") and not at("docs", "docs/") and at("x", "")
    assert pointer_path("/a/0/b~1c/~0d") == "$['a'][0]['b/c']['~d']" and pointer_path("") == "$"


def test_analysis(spark):
    df = spark.createDataFrame([("RUST café",), ("a_b-c",), ("ΟΔΟΣ",), ("½ Ⅷ x²",), ("",), (" ,. ",)], "t string")
    got = [r[0] for r in df.select(analysis.tokens(F.col("t"))).collect()]
    assert got == [["rust", "café"], ["a", "b", "c"], ["οδοσ"], ["½", "ⅷ", "x²"], [], []]
    assert [analysis.query_tokens(r["t"]) for r in df.collect()] == got


def test_vector_forms_agree(spark):
    rng = random.Random(1)
    v = [[rng.uniform(-1, 1) for _ in range(160)] for _ in range(5)]
    df = spark.createDataFrame([(x,) for x in v], "v array<float>")
    q = [rng.uniform(-1, 1) for _ in range(160)]
    for metric in S.Metric:
        long = [r[0] for r in df.select(vectors.score(F.col("v"), q, metric)).collect()]
        vectors.UNROLL, old = 1000, vectors.UNROLL
        short = [r[0] for r in df.select(vectors.score(F.col("v"), q, metric)).collect()]
        vectors.UNROLL = old
        assert long == pytest.approx(short, rel=1e-12)


def test_journal_pages_and_checkpoints(spark):
    rows = [("s1", k, f"docs/{k % 3}", Decimal(k), False, k) for k in range(10)] + [("s2", k, "other", Decimal(k), False, 100 + k) for k in range(4)] + [("s1", 10, "docs/_system/x", Decimal(1), False, 10)]
    df = spark.createDataFrame(rows, journal.CHANGE)
    page, ends = journal.read_page(df, {"s1": 2}, {"s1": 11, "s2": 4}, "docs")
    assert sorted(r["offset"] for r in page.collect()) == [*range(2, 10)] and ends == {"s1": 11, "s2": 4}
    page, ends = journal.read_page(df, {}, {"s1": 11, "s2": 4}, "", atomic_through=5)
    assert sorted((r["source"], r["offset"]) for r in page.collect()) == [("s1", k) for k in range(6)] and ends == {"s1": 6, "s2": 0}
    assert journal.check_contiguous(df).count() == 15
    with pytest.raises(Exception, match="gap"):
        journal.check_contiguous(df.filter("offset <> 3")).collect()
    token = journal.seal_checkpoint({"s1": "e", "s2": "e"}, {"s1": 6, "s2": 0}, b"k")
    assert journal.open_checkpoint(token, {"s1": "e", "s2": "e"}, {"s1": 6}, b"k") == {"s1": 6, "s2": 0}
    for epochs, floors, key in (({"s1": "e", "s2": "f"}, {}, b"k"), ({"s1": "e", "s2": "e"}, {"s1": 7}, b"k"), ({"s1": "e", "s2": "e"}, {}, b"x")):
        with pytest.raises(journal.ResumeExpired):
            journal.open_checkpoint(token, epochs, floors, key)


def test_stream_keeps_an_index_current(spark, tmp_path):
    from tessera.plans.project import project
    from tessera.streaming.generation import Generations

    spec = S.TypedJsonIndex("s", declared=(S.signed("n", S.Capability.EXACT, source="/n"),))
    schema = "path string, version decimal(20,0), content_type string, deleted boolean, payload string"
    heads = {}

    def now():
        return spark.createDataFrame([(p, Decimal(v), "application/json", n is None, json.dumps({"n": n})) for p, (v, n) in heads.items()], schema)

    g = Generations(spark, spec, str(tmp_path / "g"))
    changes = str(tmp_path / "changes")
    rng, offset = random.Random(4), 0
    for _ in range(3):
        batch = []
        for _ in range(6):
            p = f"p{rng.randrange(5)}"
            heads[p] = (heads.get(p, (0,))[0] + 1, rng.choice([None, rng.randrange(9)]))
            batch.append(("s", offset, p, Decimal(heads[p][0]), heads[p][1] is None, offset))
            offset += 1
        spark.createDataFrame(batch, journal.CHANGE).coalesce(1).write.mode("append").parquet(changes)
        stream = g.follow(journal.watch(spark, changes), now, str(tmp_path / "checkpoint"))
        stream.awaitTermination(60)
        stream.stop()
        want = sorted((r["source_path"], r["n"]) for r in project(spec, now()).collect())
        assert sorted((r["source_path"], r["n"]) for r in g.rows().collect()) == want
    assert g.current().offsets == {"s": 18}


def test_accounting(spark):
    versions = spark.createDataFrame([("tenant/7/file", 1, False, 9), ("tenant/7/file", 2, False, 5), ("tenant/7/gone", 1, False, 3), ("tenant/7/gone", 2, True, None), ("tenant/70/x", 1, False, 4)], "path string, version long, deleted boolean, length long")
    wanted = spark.createDataFrame([("",), ("tenant/7",), ("tenant/70",)], "prefix string")
    state = accounting.baseline(versions, wanted)
    as_dict = lambda df: {r["prefix"]: (r["objects"], r["stored_bytes"]) for r in df.collect()}
    assert as_dict(state) == {"": (2, 21), "tenant/7": (1, 17), "tenant/70": (1, 4)}
    delta = accounting.transitions(spark.createDataFrame([("tenant/7/file", True, False, -14), ("tenant/7/new", False, True, 2)], "path string, was_live boolean, is_live boolean, bytes_delta long"), wanted)
    assert as_dict(accounting.apply(state, delta)) == {"": (2, 9), "tenant/7": (1, 5), "tenant/70": (1, 4)}
    with pytest.raises(Exception, match="below zero"):
        accounting.apply(delta, delta.limit(0).unionByName(spark.createDataFrame([("", -9, 0)], "prefix string, objects long, stored_bytes long"))).collect()
    traffic = accounting.traffic(spark.createDataFrame([(1, "tenant/7/file", 9, 4), (1, "tenant/7/file", 9, 4)], "batch_id long, path string, bytes_in long, bytes_out long"), wanted)
    assert {r["prefix"]: (r["bytes_in"], r["bytes_out"]) for r in traffic.collect()} == {"": (9, 4), "tenant/7": (9, 4)}


AUTHZ = authz.AuthzSchema(
    {
        "user": authz.Namespace({}),
        "group": authz.Namespace({"member": [("user", ""), ("group", "member")]}),
        "folder": authz.Namespace({"viewer": [("user", ""), ("group", "member")], "parent": [("folder", "")]}, {"view": [authz.Inherit("viewer"), authz.Through("parent", "view")]}),
        "object": authz.Namespace({"writer": [("user", "")], "reader": [("user", ""), ("group", "member"), ("public", "")], "parent": [("folder", "")]}, {"read": [authz.Inherit("reader"), authz.Inherit("writer"), authz.Through("parent", "view")]}),
    }
)
TUPLES = [
    ("object", "o1", "writer", "user", "ann", ""), ("object", "o1", "reader", "group", "g1", "member"), ("group", "g1", "member", "group", "g2", "member"), ("group", "g2", "member", "user", "bob", ""), ("group", "g2", "member", "group", "g1", "member"),
    ("object", "o2", "parent", "folder", "f1", ""), ("folder", "f1", "parent", "folder", "f0", ""), ("folder", "f0", "viewer", "user", "cat", ""), ("folder", "f0", "parent", "folder", "f1", ""), ("object", "o3", "reader", "public", "*", ""),
]


def test_permissions_alone_and_in_bulk(spark):
    tuples = spark.createDataFrame(TUPLES, authz.TUPLE)
    questions = [(o, s) for o in ("o1", "o2", "o3", "o1/below") for s in ("ann", "bob", "cat", "dan")]
    one = [authz.check(AUTHZ, set(TUPLES), "object", o, "read", ("user", s)) for o, s in questions]
    assert {q for q, ok in zip(questions, one) if ok} == {("o1", "ann"), ("o1", "bob"), ("o2", "cat"), *(("o3", s) for s in ("ann", "bob", "cat", "dan"))}
    asked = spark.createDataFrame([(k, "object", o, "read", "user", s) for k, (o, s) in enumerate(questions)], "ordinal int, namespace string, object_id string, name string, subject_namespace string, subject_id string")
    assert [r["allowed"] for r in authz.check_many(AUTHZ, tuples, asked).collect()] == one
    deep = [("folder", f"f{k}", "parent", "folder", f"f{k + 1}", "") for k in range(40)] + [("folder", "f40", "viewer", "user", "eve", "")]
    with pytest.raises(authz.AuthzError):
        authz.check(AUTHZ, set(deep), "folder", "f0", "view", ("user", "eve"))
    with pytest.raises(authz.AuthzError):
        authz.expand(AUTHZ, spark.createDataFrame(deep, authz.TUPLE), spark.createDataFrame([("user", "eve")], "subject_namespace string, subject_id string"))
    new, revision = authz.mutate_tuples(AUTHZ, tuples, [TUPLES[0], ("object", "o9", "writer", "user", "dan", "")], [TUPLES[1]], 3, 3)
    assert revision == 4 and new.count() == len(TUPLES)
    with pytest.raises(authz.AuthzError):
        authz.mutate_tuples(AUTHZ, tuples, [("object", "o1", "writer", "group", "g1", "member")], [], 1)
    assert [r["object_id"] for r in authz.read_tuples(tuples, namespace="folder", limit=1).collect()] == ["f0"]
    with pytest.raises(authz.AuthzError):
        authz.AuthzSchema({"a": authz.Namespace({"r": [("b", "x")]})})


LEDGER = program.Program(
    "charge",
    {"account": program.Document("accounts/{id}"), "entry": program.Document("ledger/{id}/{n}", expected="absent")},
    ({"assert": "exists", "document": "account", "pointer": "/balance"}, {"assert": "compare", "document": "account", "pointer": "/balance", "op": "ge", "value": {"input": "least"}}, {"assert": "absent", "document": "entry"}),
    ({"do": "add", "document": "account", "pointer": "/balance", "value": {"input": "amount"}, "unsigned": True, "most": 1000}, {"do": "replace", "document": "entry", "value": {"const": {"amount": 0}}}, {"do": "set", "document": "entry", "pointer": "/amount", "value": {"input": "amount"}}, {"do": "copy", "document": "entry", "pointer": "/before", "value": {"document": "account", "pointer": "/balance", "view": "before"}}),
    {"balance": {"document": "account", "pointer": "/balance"}},
)


def test_programs():
    state = {"accounts/a": (9, {"balance": 70})}
    given = {"id": "a", "n": "1", "amount": 25, "least": 10}
    out = program.evaluate(LEDGER, given, state)
    assert out.outputs == {"balance": 95} and out.writes == {"accounts/a": {"balance": 95}, "ledger/a/1": {"amount": 25, "before": 70}} and state["accounts/a"][1] == {"balance": 70}
    after = program.commit(out, state)
    assert after["accounts/a"] == (10, {"balance": 95}) and after["ledger/a/1"][0] == 1
    assert program.evaluate(LEDGER, given, state).fingerprint == out.fingerprint
    for bad in ({"least": 71}, {"amount": -71}, {"amount": 2000}, {"id": "a/b"}, {"amount": 1.5}, {"id": "b"}):
        with pytest.raises(program.ProgramError):
            program.evaluate(LEDGER, given | bad, state)
    with pytest.raises(program.ProgramError):
        program.commit(out, after)
    with pytest.raises(program.ProgramError):
        program.evaluate(LEDGER, given, after)
    assert program.path_intents(LEDGER, given) == {"accounts/a": "put", "ledger/a/1": "put"}
    doc = {"a": [1, {"b/c": 2}]}
    assert program.select(doc, "/a/1/b~1c") == 2 and program.select(doc, "/a/01") is program.MISSING
    assert program.remove_value(doc, "/a/0") == {"a": [{"b/c": 2}]}
    with pytest.raises(program.ProgramError):
        program.set_value({"a": []}, "/a/0", 1)


def test_change_logs(spark):
    log = spark.createDataFrame([], "db string, grp string, log_index long, previous string, payload string, hash string")
    at, last = 0, None
    for k in range(4):
        log = changelog.append(log, "d", "g", f"entry {k}", at, last)
        at, last = at + 1, log.orderBy(F.desc("log_index")).first()["hash"]
    assert changelog.append(log, "d", "g", "entry 3", 3, log.filter("log_index = 3").first()["hash"]).count() == 4
    with pytest.raises(ValueError):
        changelog.append(log, "d", "g", "x", 2, last)
    assert [r["ok"] for r in changelog.verify(log).orderBy("log_index").collect()] == [True] * 4
    broken = log.withColumn("payload", F.when(F.col("log_index") == 2, "forged").otherwise(F.col("payload")))
    assert [r["ok"] for r in changelog.verify(broken).orderBy("log_index").collect()] == [True, False, True, True]
    assert [r["log_index"] for r in changelog.catch_up(log, 1, log.filter("log_index = 1").first()["hash"], 2).collect()] == [2, 3]
    assert [r["log_index"] for r in changelog.catch_up(log, 0, None, 9, 8).collect()] == [1]
    with pytest.raises(ValueError):
        changelog.catch_up(log, 1, "no")
    assert changelog.mirror(log, log.filter("log_index <= 2"), 3).select("log_index").collect()[0][0] == 3
    with pytest.raises(Exception, match="broken"):
        changelog.mirror(broken, log.limit(0), 4).collect()


def test_normalisation(spark, tmp_path):
    record = {"id": " A-1 ", "modified": "2026-07-14T01:02:03Z", "aliases": [" x", "x", ""], "affected": [{"package": {"ecosystem": "npm", "name": "Example"}, "versions": ["1"]}, {"package": {"ecosystem": "npm", "name": "example "}, "versions": ["2", "1"]}, {"package": {"ecosystem": "Go", "name": "Mod"}}]}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1.json", json.dumps(record))
        z.writestr("2.json", json.dumps({"id": "B", "affected": []}))
        z.writestr("bad.json", "{")
        z.writestr("skip.txt", "x")
    found = objects.zip_records(spark, str(tmp_path))
    assert sorted((r["entry"], r["problem"]) for r in found.collect()) == [("1.json", None), ("2.json", None), ("bad.json", "malformed")]
    own = found.filter("problem is null").select(F.from_json("payload", normalize.RECORD).alias("r")).select("r.*")
    out = {(r["id"], r["ecosystem"], r["package"]): r for r in normalize.records(own, ["npm"]).collect()}
    assert out.keys() == {("A-1", "npm", "example"), ("A-1", "go", "Mod"), ("B", "unscoped", "B")}
    r = out["A-1", "npm", "example"]
    assert (r["affected"], r["versions"], r["aliases"], r["modified_day"], r["partition"], r["state"]) == (2, ["1", "2"], ["x"], "2026-07-14", "npm", "active")
    assert out["B", "unscoped", "B"]["modified_day"] == "unknown" and out["A-1", "go", "Mod"]["partition"] == "other"
    objects.write_shards(normalize.records(own), str(tmp_path / "shards"))
    assert spark.read.json(str(tmp_path / "shards")).count() == 3
    assert zipfile.is_zipfile(io.BytesIO((tmp_path / "a.zip").read_bytes()))


def test_placement_moves_little(spark):
    keys = spark.range(300).select(F.col("id").alias("key"))
    nodes = lambda n: spark.createDataFrame([(f"n{k}", 1.0) for k in range(n)], "node string, weight double")
    first = lambda n: {r["key"]: r["node"] for r in placement.rank(keys, nodes(n), 1).collect()}
    a, b = first(5), first(6)
    moved = [k for k in a if a[k] != b[k]]
    assert all(b[k] == "n5" for k in moved) and 20 <= len(moved) <= 90


def test_catalog(tmp_path):
    c = Catalog(str(tmp_path / "catalog.json"))
    spec = S.TypedJsonIndex("t", S.Scope("docs"), (S.signed("n", S.Capability.EXACT, S.Capability.ORDER, source="/n"),), (("n", True),))
    assert c.create(spec) == 1 and c.get("t") == (spec, 1) and c.get("t")[0].fingerprint() == spec.fingerprint()
    hybrid = S.HybridIndex("h", source="/v", dims=3, metric=S.Metric.DOT, declared=(S.text("body", source="/b"),))
    c.create(hybrid)
    assert c.get("h")[0] == hybrid and c.list() == ["h", "t"] and c.list("h") == ["t"]
    with pytest.raises(S.DefinitionError):
        c.create(spec)
    with pytest.raises(S.DefinitionError):
        c.update(spec, 9)
    assert c.update(S.TypedJsonIndex("t", declared=spec.declared), 1) == 2
    assert c.rebuild("t", lambda s: s.name) == "t"
    with pytest.raises(S.QueryError):
        c.rebuild("t", lambda s: s.name)
    with pytest.raises(S.QueryError):
        c.query("t", "vector", lambda s: s)
    c.delete("h", 1)
    assert c.list() == ["t"]


def test_page_tokens():
    claims = order.Claims("t", "s", "i", "f", 1, order.query_hash("q"), 7)
    cursor = {"a": 1.5, "a__present": True, "b": None, "result_path": "p", "result_version": Decimal(2**64 - 1)}
    token = order.seal(cursor, claims, b"k")
    assert order.unseal(token, claims, b"k") == cursor
    for other, key in ((order.Claims("t", "s", "i", "f", 2, claims.query, 7), b"k"), (claims, b"x")):
        with pytest.raises(S.QueryError):
            order.unseal(token, other, key)
    with pytest.raises(S.QueryError):
        order.unseal("AAAA", claims, b"k")

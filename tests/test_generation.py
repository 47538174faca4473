"""Versions, statistics and physical order of generations; schemas, selectors, groups and snapshots."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.operators import authz, changelog, scan
from tessera.operators.predicate import And, Compare, Equal, FullText, Not, Or, Prefix, compile_predicate
from tessera.plans import schema as S
from tessera.streaming.generation import Generations

C = S.Capability
SPEC = S.TypedJsonIndex("g", declared=(S.signed("n", C.EXACT, C.RANGE, C.ORDER, source="/n"), S.text("t", source="/t")), physical_order=(("n", True),))


def heads(spark, rows):
    """(path, version, n); n None: deleted."""
    full = [(p, Decimal(v), "application/json", n is None, f'{{"n": {n or 0}, "t": "one two"}}') for p, v, n in rows]
    return spark.createDataFrame(full, "path string, version decimal(20,0), content_type string, deleted boolean, payload string")


def told(g):
    return sorted((r["source_path"], int(r["source_version"]), r["n"]) for r in g.rows().collect())


def change(g, spark, rows, **how):
    return g.apply(spark.createDataFrame([(p,) for p, *_ in rows], "path string"), heads(spark, [r for r in rows if r[1]]), **how)


def test_highest_version_wins_and_equal_ones_must_agree(spark, tmp_path):
    g = Generations(spark, SPEC, str(tmp_path / "g"))
    g.build(heads(spark, [("a", 3, 1), ("b", 1, 2), ("c", 5, 3)]))
    change(g, spark, [("a", 2, 9), ("b", 4, None)])  # a late one, and a tombstone
    assert told(g) == [("a", 3, 1), ("c", 5, 3)]
    change(g, spark, [("b", 3, 8)])  # older than the tombstone
    assert told(g) == [("a", 3, 1), ("c", 5, 3)]
    change(g, spark, [("c", 0, None)])  # gone without a version
    assert told(g) == [("a", 3, 1)]
    change(g, spark, [("a", 3, 1), ("c", 6, 4)])  # the same again, and a new start
    assert told(g) == [("a", 3, 1), ("c", 6, 4)]
    before = told(g)
    g.compact(True)
    assert told(g) == before
    change(g, spark, [("a", 3, 7)])
    with pytest.raises(Exception, match="two contents of one version"):
        g.rows().collect()


def test_statistics_and_early_stop(spark, tmp_path):
    g = Generations(spark, SPEC, str(tmp_path / "g"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one file
    g.build(heads(spark, [(f"p{k:04d}", 1, k * 7919 % 1000) for k in range(1000)]))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    s = g.statistics()[0]
    assert (s["rows"], s["least"], s["most"], s["docs:t"], s["length:t"]) == (1000, "0", "999", 1000, 2000)
    found, files = g.first(compile_predicate(Compare("n", "<", 990), SPEC), 5)
    assert [r["n"] for r in found.collect()] == [989, 988, 987, 986, 985] and files == 1
    found, files = g.first(compile_predicate(Compare("n", "<", 3), SPEC), 5)
    assert [r["n"] for r in found.collect()] == [2, 1, 0] and files > 1
    change(g, spark, [("p0000", 2, 5000)])
    found, files = g.first(None, 2)
    assert [r["n"] for r in found.collect()] == [5000, 999] and files == -1
    assert g.vacuum(1, 0, most_bytes=0) == [1]


def test_selectors_and_schema_store(spark, tmp_path):
    schema = authz.AuthzSchema({"user": authz.Namespace({}), "team": authz.Namespace({"m": [("user", "")]}), "doc": authz.Namespace({"r": [("user", "", "ann"), ("team", "m"), ("team", "m", "="), ("public", "")], "own": [("team", "m", "=")]})})
    ok = [("doc", "d", "r", "user", "ann", ""), ("doc", "d", "r", "team", "x", "m"), ("doc", "d", "r", "public", "*", ""), ("doc", "d", "own", "team", "d", "m")]
    bad = [("doc", "d", "r", "user", "bob", ""), ("doc", "d", "r", "public", "x", ""), ("doc", "d", "own", "team", "x", "m"), ("doc", "d", "r", "team", "x", ""), ("no", "d", "r", "user", "ann", "")]
    assert all(map(schema.allows, ok)) and not any(map(schema.allows, bad))
    store = authz.SchemaStore(str(tmp_path / "s"), spark)
    assert store.put("a", schema, 0) == 1 and store.get("a") == schema
    with pytest.raises(authz.AuthzError):
        store.put("a", schema, 0)
    with pytest.raises(authz.AuthzError):
        store.bind("b", "a", 7)
    store.bind("b", "a", 1)
    assert store.of_bucket("b") == schema
    with pytest.raises(authz.AuthzError):
        store.of_bucket("other")


def test_more_subjects_than_a_thousand(spark):
    schema = authz.AuthzSchema({"user": authz.Namespace({}), "doc": authz.Namespace({"r": [("user", ""), ("public", "")]})})
    tuples = spark.createDataFrame([("doc", "open", "r", *authz.PUBLIC), ("doc", "own", "r", "user", "u7", "")], authz.TUPLE)
    asked = spark.range(3000).select(F.col("id").cast("int").alias("ordinal"), F.lit("doc").alias("namespace"), F.when(F.col("id") % 2 == 0, "open").otherwise("own").alias("object_id"), F.lit("r").alias("name"), F.lit("user").alias("subject_namespace"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("subject_id"))
    got = authz.check_many(schema, tuples, asked).filter("allowed").collect()
    assert {r["ordinal"] for r in got} == {7, *range(0, 3000, 2)}


def test_groups_and_snapshots(spark):
    members = spark.createDataFrame([("d", "g", "ann", "writer"), ("d", "g", "bob", "reader"), ("d", "h", "ann", "reader")], "db string, grp string, member string, role string")
    groups = changelog.create_groups(members)
    assert [tuple(r) for r in changelog.describe(groups).orderBy("grp").collect()] == [("d", "g", 2, 1, 1), ("d", "h", 1, 0, 1)]
    assert [r["grp"] for r in changelog.list_groups(groups, "d", "g").collect()] == ["h"]
    assert changelog.may(groups, "d", "g", "ann", True) and not changelog.may(groups, "d", "h", "ann", True) and changelog.may(groups, "d", "h", "ann", False)
    for wrong in ([("d", "g", "x", "chief")], [("d", "g", "x", "writer"), ("d", "g", "x", "reader")]):
        with pytest.raises(Exception, match="role"):
            changelog.create_groups(spark.createDataFrame(wrong, members.schema)).collect()
    entries = spark.createDataFrame([("d", "g", k, f"h{k}") for k in (1, 2, 3)], "db string, grp string, log_index int, hash string")
    snaps = spark.createDataFrame([("d", "g", 1, "h1", ["a"]), ("d", "g", 3, "h3", ["b", "c"])], "db string, grp string, log_index int, hash string, files array<string>")
    known = changelog.register_snapshots(entries, snaps)
    assert changelog.latest_snapshots(known).first()["files"] == ["b", "c"] and changelog.latest_snapshots(known, 2).first()["log_index"] == 1
    with pytest.raises(Exception, match="no such entry"):
        changelog.register_snapshots(entries, snaps.withColumn("hash", F.lit("h1"))).collect()


def test_scan_contract():
    spec = S.TypedJsonIndex("s", declared=(S.keyword("k", C.EXACT, C.PREFIX, source="/k"), S.keyword("m", C.EXACT, source="/m", multi=True), S.text("t", source="/t")))
    kind = lambda p: scan.classify(spec, p).value
    cases = [(Equal("k", "x"), "exact"), (Prefix("k", "x"), "inexact"), (Equal("m", "x"), "unsupported"), (FullText("t", "x"), "unsupported"), (And((Equal("k", "x"), Prefix("k", "x"))), "inexact"), (Or((Equal("k", "x"), Equal("m", "x"))), "unsupported"), (Not(Equal("k", "x")), "exact"), (Not(Prefix("k", "x")), "unsupported")]
    assert [kind(p) for p, _ in cases] == [w for _, w in cases]
    assert scan.classify(spec, Equal("k", "x"), stored=set()).value == "unsupported"

"""Queries for the operators that keep state: generations, journals, programs, permissions, logs, definitions.

Like those of ``queries``, each runs over the driver's whole tables and has the SQL that says the same. What they
write goes to the application's folder (``sources.scratch``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import paths
from tessera.operators import authz, changelog, compute, order, program, store
from tessera.operators.predicate import Compare, Equal, In, Not, Prefix, compile_predicate, decode_literal
from tessera.operators.scan import plan
from tessera.operators.search import Freshness, IndexQuery, search
from tessera.plans import schema as S
from tessera.plans.catalog import Catalog
from tessera.plans.project import project
from tessera.queries import _O, EVENTS, GRAPH, ORDERS, _path, conversation_log, events, graph, hits, load, orders, query
from tessera.queries import _padded as padded
from tessera.sources import objects, scratch
from tessera.streaming import accounting, journal
from tessera.streaming.generation import Generations

C = S.Capability

# generations -----------------------------------------------------------------------------------------------------

SORTED = S.TypedJsonIndex(
    "sorted",
    declared=(
        S.keyword("status", C.EXACT, C.ORDER, C.FACET, source=S.Expr("o_orderstatus")),
        S.unsigned("key", C.EXACT, C.RANGE, C.ORDER, source=S.Expr("o_orderkey")),
        S.double("total", C.RANGE, C.ORDER, C.AGGREGATE, source=S.Expr("o_totalprice")),
    ),
    physical_order=(("total", True), ("key", False)),
)


def _heads(spark, sf, version=1, total="o_totalprice", gone="false"):
    """Orders as heads of a version, some of them deleted."""
    own = load(spark, sf, "orders").withColumn("o_totalprice", F.expr(total))
    return objects.as_objects(own, padded("orders", "o_orderkey"), version).withColumn("deleted", F.expr(gone))


def _generations(spark, spec=SORTED, name="index"):
    return Generations(spark, spec, scratch.folder(spark, name))


def _told(g: Generations) -> DataFrame:
    return hits(g.rows(), F.col("source_version").cast("long").alias("version"), "status", "total")


def _some(spark, sf, where: str) -> DataFrame:
    return load(spark, sf, "orders").filter(where).select(padded("orders", "o_orderkey").alias("path"))


_PLAIN = f"SELECT {_O} AS path, 1 AS version, o_orderstatus AS status, o_totalprice AS total FROM orders"


@query(_PLAIN)
def gen_build(spark, sf):
    """A full build, published, and read back."""
    g = _generations(spark)
    g.build(_heads(spark, sf))
    return _told(g)


_SECOND = f"SELECT {_O} AS path, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS total FROM orders WHERE o_orderstatus <> 'P'"


def _second(spark, sf) -> Generations:
    """Finished orders change and pending ones go, in a batch that comes twice."""
    g = _generations(spark)
    g.build(_heads(spark, sf), {"s": 1})
    after = _heads(spark, sf, F.when(F.col("o_orderstatus") == "O", 1).otherwise(2), "case when o_orderstatus = 'F' then o_totalprice + 1 else o_totalprice end", "o_orderstatus = 'P'")
    for _ in range(2):
        g.apply(_some(spark, sf, "o_orderstatus <> 'O'"), after, {"s": 2}, 0)
    return g


@query(_SECOND)
def gen_apply(spark, sf):
    return _told(_second(spark, sf))


@query(_SECOND)
def gen_compact(spark, sf):
    g = _second(spark, sf)
    g.compact(True)
    return _told(g)


@query("SELECT 3 AS generation, 1 AS segments, 2 AS offset, 0 AS batch")
def gen_manifest(spark, sf):
    """What the manifest tells after a build, a batch that came twice, and a compaction."""
    g = _second(spark, sf)
    m = g.compact(True)
    return spark.createDataFrame([(m.generation, len(m.segments), m.offsets["s"], m.batch)], "generation int, segments int, offset int, batch int")


@query("SELECT 2 AS generation, 1 AS segments, 7 AS offset")
def gen_checkpoint_only(spark, sf):
    """A batch without changes publishes where the journal stands."""
    g = _generations(spark)
    g.build(_heads(spark, sf), {"s": 1})
    m = g.apply(_some(spark, sf, "false"), _heads(spark, sf), {"s": 7}, 0)
    return spark.createDataFrame([(m.generation, len(m.segments), m.offsets["s"])], "generation int, segments int, offset int")


@query(f"SELECT {_O} AS path, CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 3 END AS version, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS total FROM orders")
def gen_late_version(spark, sf):
    """A batch that brings an older version after a newer one changes nothing."""
    g = _generations(spark)
    g.build(_heads(spark, sf, 3))
    changed = _some(spark, sf, "o_orderstatus = 'F'")
    g.apply(changed, _heads(spark, sf, 5, "o_totalprice + 1"), batch=0)
    g.apply(changed, _heads(spark, sf, 4, "o_totalprice + 9"), batch=1)
    return _told(g)


@query("SELECT segment, rows, gone, least_version, most_version FROM (SELECT 0 AS segment, count(*) AS rows, 0 AS gone, 1 AS least_version, 1 AS most_version FROM orders UNION ALL SELECT 1, count(*), count(*) FILTER (o_orderstatus = 'P'), 2, 2 FROM orders WHERE o_orderstatus <> 'O')")
def gen_segment_statistics(spark, sf):
    told = _second(spark, sf).statistics()
    return spark.createDataFrame([(k, s["rows"], s["gone"], int(s["least_version"]), int(s["most_version"])) for k, s in enumerate(told)], "segment int, rows long, gone long, least_version int, most_version int")


@query(f"SELECT {_O} AS path, o_totalprice AS total FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_totalprice DESC, o_orderkey, 1 LIMIT 75")
def gen_physical_order(spark, sf):
    """The first hits in the order in which the index is stored; files behind them are not read."""
    g = _generations(spark)
    g.build(_heads(spark, sf))
    found, _ = g.first(compile_predicate(Not(Equal("status", "O")), SORTED), 75)
    return hits(found, "total")


@query("SELECT unnest([1, 2]) AS removed")
def gen_retention(spark, sf):
    """Four generations, of which the two newest stay."""
    g = _second(spark, sf)
    g.compact(True)
    g.apply(_some(spark, sf, "false"), _heads(spark, sf), batch=9)
    return spark.createDataFrame([(k,) for k in g.vacuum(2, 0)], "removed int")


@query("SELECT 'rebuilding' AS state")
def gen_old_definition(spark, sf):
    """A generation of another definition isn't read."""
    g = _generations(spark)
    g.build(_heads(spark, sf))
    other = Generations(spark, S.TypedJsonIndex("sorted", declared=SORTED.declared[:2]), g.where)
    try:
        other.rows()
        state = "read"
    except LookupError:
        state = "rebuilding"
    return spark.createDataFrame([(state,)], "state string")


def _log(spark, sf) -> DataFrame:
    """The journal of users' events: each kind of event is a source with offsets of its own."""
    own = load(spark, sf, "events")
    return own.select(F.col("event_type").alias("source"), F.col("event_id").cast("long").alias("offset"), F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), (F.col("event_id") + 1).cast("decimal(20,0)").alias("version"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("commit_id"))


KINDS_INDEX = S.TypedJsonIndex("kinds", declared=(S.keyword("kind", C.EXACT, source=S.Expr("source")),))
_FENCE = "(SELECT max(event_id) / 2 FROM events)"


def _versions(log: DataFrame, fence: float | None = None) -> DataFrame:
    own = log if fence is None else objects.snapshot(log, {k: fence for k in ("view", "click", "purchase", "signup", "error")})
    return objects.current_heads(own.select("path", "version", "deleted", "source"))


def _half(log: DataFrame) -> float:
    return log.agg(F.max("offset")).first()[0] / 2


@query(f"SELECT 'users/' || CAST(user_id AS VARCHAR) AS path, max(event_id) + 1 AS version FROM events WHERE event_id < {_FENCE} GROUP BY user_id")
def snapshot_fenced(spark, sf):
    """Heads as of one offset of each source."""
    log = _log(spark, sf)
    return _versions(log, _half(log)).select("path", F.col("version").cast("long").alias("version"))


@query("SELECT 'users/' || CAST(user_id AS VARCHAR) AS path, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def gen_rebuild_replay(spark, sf):
    """A build from a fenced snapshot, and then the changes behind the fence."""
    log = _log(spark, sf)
    half = _half(log)
    g = _generations(spark, KINDS_INDEX)
    g.build(_versions(log, half))
    g.apply(log.filter(F.col("offset") >= half), _versions(log), batch=0)
    return hits(g.rows(), "kind")


def _stream(spark, sf, log: DataFrame, files: int, per_trigger: int | None, prefix: str = "") -> Generations:
    g = _generations(spark, KINDS_INDEX)
    changes = scratch.folder(spark, "changes")
    log.repartition(files, "offset").write.parquet(changes)
    heads = scratch.written(_versions(log))
    g.build(heads.limit(0))
    stream = g.follow(journal.watch(spark, changes, prefix, per_trigger), lambda: heads, scratch.folder(spark, "checkpoint"))
    stream.awaitTermination()
    return g


@query("SELECT 'users/' || CAST(user_id AS VARCHAR) AS path, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def stream_follow(spark, sf):
    """A stream of changes that an index follows, one file a batch."""
    return hits(_stream(spark, sf, _log(spark, sf), 3, 1).rows(), "kind")


@query("SELECT event_type AS source, max(event_id) + 1 AS offset FROM events GROUP BY 1")
def stream_offsets(spark, sf):
    """Where each source goes on after a stream."""
    m = _stream(spark, sf, _log(spark, sf), 2, None).current()
    return spark.createDataFrame([*m.offsets.items()], "source string, offset long")


@query("SELECT count(*) AS seen, min(event_id) AS least, max(event_id) AS most FROM events WHERE user_id = 7")
def stream_watch_prefix(spark, sf):
    """Invalidations under one prefix: users/7 and what is below, not users/70."""
    changes, out = scratch.folder(spark, "changes"), scratch.folder(spark, "seen")
    _log(spark, sf).repartition(2).write.parquet(changes)
    stream = journal.watch(spark, changes, "users/7").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.folder(spark, "checkpoint")).trigger(availableNow=True).start()
    stream.awaitTermination()
    seen = spark.read.schema("source string, offset long").parquet(out)
    return seen.agg(F.count("*").alias("seen"), F.min("offset").alias("least"), F.max("offset").alias("most"))


# journal -----------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS source, event_id AS offset FROM events e WHERE event_id < (SELECT min(event_id) FROM events x WHERE x.event_type = e.event_type AND x.event_id > (SELECT 2 * max(event_id) / 3 FROM events)) OR NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = e.event_type AND x.event_id > (SELECT 2 * max(event_id) / 3 FROM events))")
def journal_atomic_page(spark, sf):
    """A page ends in each source before the first change of a commit that isn't settled."""
    log = _log(spark, sf)
    most = log.agg(F.max("offset")).first()[0]
    page, _ = journal.read_page(log, {}, {k: most + 1 for k in ("view", "click", "purchase", "signup", "error")}, "users", 2 * most // 3)
    return page.select("source", "offset")


@query("SELECT event_type AS source, max(event_id) + 1 AS offset FROM events GROUP BY 1")
def journal_checkpoint(spark, sf):
    """A vector checkpoint, sealed and opened again."""
    ends = {r["source"]: r["o"] + 1 for r in _log(spark, sf).groupBy("source").agg(F.max("offset").alias("o")).collect()}
    epochs = dict.fromkeys(ends, "e1")
    token = journal.seal_checkpoint(epochs, ends, b"secret")
    return spark.createDataFrame([*journal.open_checkpoint(token, epochs, ends, b"secret").items()], "source string, offset long")


@query("SELECT event_type AS source, min(event_id) = (SELECT min(event_id) FROM events) AS resumes FROM events GROUP BY 1")
def journal_retention_floor(spark, sf):
    """A source resumes from the journal's first offset only if that is still retained."""
    log = _log(spark, sf)
    low = log.agg(F.min("offset")).first()[0]
    floors = {r["source"]: r["o"] for r in log.groupBy("source").agg(F.min("offset").alias("o")).collect()}
    rows = []
    for source, floor in floors.items():
        try:
            journal.open_checkpoint(journal.seal_checkpoint({source: "e"}, {source: low}, b"k"), {source: "e"}, {source: floor}, b"k")
            rows.append((source, True))
        except journal.ResumeExpired:
            rows.append((source, False))
    return spark.createDataFrame(rows, "source string, resumes boolean")


# mutations, programs -------------------------------------------------------------------------------------------------

_CHARGE = program.Program(
    "charge",
    {"account": program.Document("accounts/{id}"), "entry": program.Document("ledger/{id}/{n}", expected="absent")},
    ({"assert": "exists", "document": "account", "pointer": "/balance"}, {"assert": "compare", "document": "account", "pointer": "/balance", "op": "ge", "value": {"input": "least"}}, {"assert": "absent", "document": "entry"}),
    (
        {"do": "add", "document": "account", "pointer": "/balance", "value": {"input": "amount"}, "most": 900_000},
        {"do": "remove", "document": "account", "pointer": "/note"},
        {"do": "replace", "document": "entry", "value": {"const": {"amount": 0, "by": ["x", {"a/b": 1}]}}},
        {"do": "set", "document": "entry", "pointer": "/amount", "value": {"input": "amount"}},
        {"do": "copy", "document": "entry", "pointer": "/by/1/a~1b", "value": {"document": "account", "pointer": "/balance", "view": "before"}},
    ),
    {"balance": {"document": "account", "pointer": "/balance"}},
)
_CENTS = "CAST(round(c_acctbal * 100) AS BIGINT)"


def _charges(spark, sf) -> DataFrame:
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    given = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.lit("1").alias("n"), (F.col("c_nationkey") * 1000).cast("long").alias("amount"), F.lit(0).alias("least")))
    account = F.concat(F.lit('{"balance": '), cents.cast("string"), F.lit(', "note": "x"}'))
    document = F.struct(F.concat(F.lit("accounts/"), F.col("c_custkey").cast("string")).alias("path"), F.lit(3).cast("long").alias("version"), account.alias("content"))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), given.alias("given"), F.array(document).alias("documents"))


@query(f"""
SELECT id, CASE WHEN before < 0 THEN 'refused' WHEN before + amount > 900000 THEN 'refused' ELSE 'committed' END AS outcome,
  CASE WHEN before >= 0 AND before + amount <= 900000 THEN before + amount END AS balance,
  CASE WHEN before >= 0 AND before + amount <= 900000 THEN before END AS copied
FROM (SELECT c_custkey AS id, {_CENTS} AS before, CAST(c_nationkey AS BIGINT) * 1000 AS amount FROM customer)""")
def program_charge_all(spark, sf):
    """One atomic program for every customer: assertions, operations on two documents, outputs."""
    out = program.evaluate_rows(_CHARGE, _charges(spark, sf), ["id"])
    entry = F.try_element_at(F.from_json("writes", "map<string,string>"), F.concat(F.lit("ledger/"), F.col("id").cast("string"), F.lit("/1")))
    return out.select("id", F.when(F.col("error").isNull(), "committed").otherwise("refused").alias("outcome"), F.get_json_object("outputs", "$.balance").cast("long").alias("balance"), F.get_json_object(entry, "$.by[1]['a/b']").cast("long").alias("copied"))


@query("SELECT count(*) AS bundles, count(*) AS fingerprints, TRUE AS replayed FROM customer")
def program_fingerprints(spark, sf):
    """Each input has a fingerprint of its own, which a replay repeats whatever the state."""
    own = _charges(spark, sf)
    one = program.evaluate_rows(_CHARGE, own, ["id"]).select("id", "fingerprint")
    again = program.evaluate_rows(_CHARGE, own.withColumn("documents", F.array().cast("array<struct<path:string,version:bigint,content:string>>")), ["id"]).select("id", F.col("fingerprint").alias("f"))
    return one.join(again, "id").agg(F.count("*").alias("bundles"), F.count_distinct("fingerprint").alias("fingerprints"), F.every(F.col("fingerprint") == F.col("f")).alias("replayed"))


@query("SELECT c_custkey AS id, unnest(['accounts/' || CAST(c_custkey AS VARCHAR), 'ledger/' || CAST(c_custkey AS VARCHAR) || '/1']) AS path, 'put' AS intent FROM customer")
def program_intents(spark, sf):
    """What a program would do to which paths, from its input alone."""
    out = program.intent_rows(_CHARGE, _charges(spark, sf), ["id"])
    return out.select("id", "path", "intent")


@query("""
WITH m AS (SELECT event_id AS seq, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, first(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events)
SELECT seq, CASE WHEN user_id % 3 = 1 THEN 'program_only' WHEN user_id % 3 = 2 THEN 'immutable_policy_required' WHEN k = 1 THEN 'applied' WHEN event_type = f THEN 'replayed' ELSE 'immutable' END AS outcome FROM m""")
def mutation_policies(spark, sf):
    """Immutable writes under an immutable prefix, a program-only one, and one without a policy."""
    area = F.concat(F.element_at(F.array(F.lit("frozen/"), F.lit("prog/"), F.lit("free/")), (F.col("user_id") % 3 + 1).cast("int")), F.col("user_id").cast("string"))
    own = load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("command_id"), area.alias("path"), F.lit("put_immutable").alias("mode"), F.lit(None).cast("long").alias("expected"), F.col("event_type").alias("content_hash"))
    return store.fold(own, store.BucketPolicy(("frozen",), ("prog",))).select("seq", "outcome")


@query("SELECT count(*) AS writes, count(*) AS applied FROM events")
def mutation_by_program(spark, sf):
    """Under a program-only prefix a program's own writes are applied."""
    own = load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("command_id"), F.concat(F.lit("prog/"), F.col("user_id").cast("string")).alias("path"), F.lit("put").alias("mode"), F.lit(None).cast("long").alias("expected"), F.col("event_type").alias("content_hash"))
    out = store.fold(own, store.BucketPolicy((), ("prog",)), by_program=True)
    return out.agg(F.count("*").alias("writes"), F.count(F.when(F.col("outcome") == "applied", 1)).alias("applied"))


@query("""
WITH RECURSIVE m AS (SELECT event_id AS seq, user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT seq, user_id, t, k, CASE WHEN t = 'error' THEN 'not_found' ELSE 'applied' END AS outcome, CASE WHEN t = 'error' THEN 0 ELSE 1 END AS version, FALSE AS deleted FROM m WHERE k = 1
  UNION ALL SELECT m.seq, m.user_id, m.t, m.k,
    CASE WHEN m.t <> 'error' THEN 'applied' WHEN f.version < 2 OR f.deleted AND f.version = 2 THEN 'not_found' WHEN f.version > 2 THEN 'version_removed' ELSE 'applied' END,
    CASE WHEN m.t <> 'error' OR f.version = 2 AND NOT f.deleted THEN f.version + 1 ELSE f.version END,
    CASE WHEN m.t <> 'error' THEN FALSE WHEN f.version = 2 AND NOT f.deleted THEN TRUE ELSE f.deleted END
  FROM f JOIN m ON m.user_id = f.user_id AND m.k = f.k + 1)
SELECT seq, outcome, CAST(version AS BIGINT) AS version FROM f""")
def mutation_delete_version(spark, sf):
    """Errors delete the second version of their user: a retained one goes, the current one leaves a tombstone."""
    gone = F.col("event_type") == "error"
    own = load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("command_id"), F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), F.when(gone, "delete_version").otherwise("put").alias("mode"), F.when(gone, 2).cast("long").alias("expected"), F.col("props").alias("content_hash"))
    return store.fold(own).select("seq", "outcome", F.coalesce("version", F.lit(0)).alias("version"))


# permissions ---------------------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY who, k) - 1 AS ordinal, (who = 'ann' AND n = 3) OR (who = 'bob' AND r = 1) AS allowed FROM (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r, unnest(['ann', 'bob', 'cat']) AS who FROM customer JOIN nation ON n_nationkey = c_nationkey)")
def authz_bulk_check(spark, sf):
    """May ann, bob and cat view each customer?"""
    asked = load(spark, sf, "customer").select(F.explode(F.array(*map(F.lit, ("ann", "bob", "cat")))).alias("subject_id"), "c_custkey")
    n = load(spark, sf, "customer").count()
    rank = F.row_number().over(Window.partitionBy("subject_id").orderBy("c_custkey")) - 1
    at = rank + F.when(F.col("subject_id") == "ann", 0).when(F.col("subject_id") == "bob", n).otherwise(2 * n)
    asked = asked.select(at.cast("long").alias("ordinal"), F.lit("customer").alias("namespace"), F.col("c_custkey").cast("string").alias("object_id"), F.lit("view").alias("name"), F.lit("user").alias("subject_namespace"), "subject_id")
    return authz.check_many(GRAPH, graph(spark, sf), asked)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS nation, n_nationkey = 3 AS ann, n_regionkey = 1 AS bob FROM nation")
def authz_check(spark, sf):
    """One question at a time, over the grants of the nations."""
    tuples = {tuple(r) for r in graph(spark, sf).filter("namespace in ('nation', 'region')").collect()}  # 25 nations, 5 regions
    ids = [str(r[0]) for r in load(spark, sf, "nation").select("n_nationkey").collect()]
    ask = lambda i, who: authz.check(GRAPH, tuples, "nation", i, "view", ("user", who))
    return spark.createDataFrame([(i, ask(i, "ann"), ask(i, "bob")) for i in ids], "nation string, ann boolean, bob boolean")


_PUBLIC = authz.AuthzSchema({"user": authz.Namespace({}), "doc": authz.Namespace({"reader": [("user", ""), ("public", "")]}, {"read": [authz.Inherit("reader")]})})


@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang = 'en' OR doc_id % 2 = 0 AS allowed FROM documents")
def authz_public(spark, sf):
    """Documents in English are public; dan may read every second one."""
    docs = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", (F.col("doc_id") % 2 == 0).alias("even"))
    row = lambda *subject: [F.lit("doc").alias("namespace"), F.col("id").alias("object_id"), F.lit("reader").alias("relation"), *(F.lit(x).alias(c) for x, c in zip(subject, authz.KEY[3:]))]
    tuples = docs.filter("lang = 'en'").select(*row(*authz.PUBLIC)).union(docs.filter("even").select(*row("user", "dan", "")))
    asked = docs.select(F.col("id").cast("int").alias("ordinal"), F.lit("doc").alias("namespace"), F.col("id").alias("object_id"), F.lit("read").alias("name"), F.lit("user").alias("subject_namespace"), F.lit("dan").alias("subject_id"))
    return authz.check_many(_PUBLIC, tuples, asked).select(F.col("ordinal").cast("string").alias("id"), "allowed")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS object_id FROM orders WHERE CAST(o_orderkey AS VARCHAR) > '2' ORDER BY 1 LIMIT 1000")
def authz_read_tuples(spark, sf):
    """A page of the orders' tuples behind a cursor."""
    return authz.read_tuples(graph(spark, sf), ("order", "2", "parent", "zzz", "", ""), namespace="order").select("object_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS object_id, CASE WHEN n_nationkey = 5 THEN 'eve' ELSE CAST(n_regionkey AS VARCHAR) END AS subject_id, 8 AS revision FROM nation WHERE n_nationkey <> 4")
def authz_mutate(spark, sf):
    """Tuples taken away and put in, all or nothing; doing it again changes nothing."""
    own = graph(spark, sf).filter("namespace = 'nation' and subject_namespace = 'region'")
    region = {r[0]: str(r[1]) for r in load(spark, sf, "nation").select("n_nationkey", "n_regionkey").collect()}  # 25 nations
    tup = lambda k: ("nation", str(k), "viewer", "region", region[k], "member")
    add, remove, revision = [("nation", "5", "viewer", "user", "eve", "")], [tup(4), tup(5)], 6
    for _ in range(2):
        own, revision = authz.mutate_tuples(GRAPH, own, add, remove, revision, revision)
    return own.select("object_id", "subject_id", F.lit(revision).alias("revision"))


@query("SELECT unnest(['schema 1', 'schema 2', 'bound 2', 'stale', 'dangling']) AS step, unnest(['ok', 'ok', 'ok', 'refused', 'refused']) AS result")
def authz_schema_catalog(spark, sf):
    """Schemas are put by revision and bound to a bucket; what they can't mean is refused."""
    store_ = authz.SchemaStore(scratch.folder(spark, "authz"), spark)
    rows = []

    def step(name, run):
        try:
            run()
            rows.append((name, "ok"))
        except authz.AuthzError:
            rows.append((name, "refused"))

    step("schema 1", lambda: store_.put("graph", GRAPH, 0))
    step("schema 2", lambda: store_.put("graph", _PUBLIC, 1))
    step("bound 2", lambda: (store_.bind("bucket", "graph", 2), store_.of_bucket("bucket").namespaces["doc"]))
    step("stale", lambda: store_.put("graph", GRAPH, 1))
    step("dangling", lambda: authz.AuthzSchema({"a": authz.Namespace({"r": [("b", "x")]})}))
    return spark.createDataFrame(rows, "step string, result string")


# logs ----------------------------------------------------------------------------------------------------------------


_CHAIN = """
WITH RECURSIVE t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
c AS (SELECT conv_id, i, sha256('|' || text) AS h FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.i, sha256(c.h || '|' || t.text) FROM t JOIN c ON t.conv_id = c.conv_id AND t.i = c.i + 1)"""


@query(f"{_CHAIN} SELECT conv_id, i AS log_index, h AS hash FROM c WHERE i > 1 AND i <= 3")
def changelog_mirror(spark, sf):
    """A mirror that has the first entry of each log copies the verified rest, up to a checkpoint."""
    log = conversation_log(spark, sf).withColumn("log_index", F.col("log_index") + 1)
    return changelog.mirror(log, log.filter("log_index = 1"), 3).select(F.col("grp").alias("conv_id"), F.col("log_index").cast("long").alias("log_index"), "hash")


@query(f"{_CHAIN}, o AS (SELECT conv_id, max(i) AS n, arg_max(h, i) AS h FROM c GROUP BY 1) SELECT n + 1 AS entries, sha256(h || '|' || 'one more') AS hash, TRUE AS repeated, 'refused' AS late FROM o WHERE conv_id = (SELECT min(conv_id) FROM o)")
def changelog_append(spark, sf):
    """An append to one log behind its last entry; again, which changes nothing; and one behind an older entry."""
    log = conversation_log(spark, sf).withColumn("log_index", (F.col("log_index") + 1).cast("long")).select("db", F.col("grp").cast("string").alias("grp"), "log_index", "previous", "payload", "hash")
    one = log.agg(F.min(F.col("grp").cast("long"))).first()[0]
    own = scratch.written(log.filter(F.col("grp") == str(one)))
    last = own.orderBy(F.desc("log_index")).first()
    more = scratch.written(changelog.append(own, "db", str(one), "one more", last["log_index"], last["hash"]))
    again = changelog.append(more, "db", str(one), "one more", last["log_index"], last["hash"])
    try:
        changelog.append(more, "db", str(one), "late", last["log_index"], last["hash"])
        late = "taken"
    except ValueError:
        late = "refused"
    return again.agg(F.count("*").alias("entries"), F.max_by("hash", "log_index").alias("hash")).withColumn("repeated", F.lit(True)).withColumn("late", F.lit(late))


@query("SELECT conv_id, count(*) AS members, count(*) FILTER (turn = 0) AS writers FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY 1")
def changelog_groups(spark, sf):
    """Groups with their members and roles, a description of each."""
    turns = load(spark, sf, "conversations").select("conv_id", "turn").distinct()
    members = turns.select(F.lit("db").alias("db"), F.col("conv_id").cast("string").alias("grp"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("member"), F.when(F.col("turn") == 0, "writer").otherwise("reader").alias("role"))
    return changelog.describe(changelog.create_groups(members)).select(F.col("grp").cast("long").alias("conv_id"), "members", "writers")


@query(f"{_CHAIN} SELECT conv_id, max(i) AS log_index, arg_max(h, i) AS hash FROM c GROUP BY 1")
def changelog_snapshots(spark, sf):
    """A snapshot of every log at its end: registered against the log, and the newest one got back."""
    log = conversation_log(spark, sf).withColumn("log_index", F.col("log_index") + 1)
    ends = log.groupBy("db", "grp").agg(F.max_by(F.struct("log_index", "hash"), "log_index").alias("e")).select("db", "grp", "e.log_index", "e.hash")
    files = ends.withColumn("files", F.array(F.concat(F.lit("snap/"), F.col("grp").cast("string"))))
    early = files.withColumn("log_index", F.lit(1)).drop("hash").join(log.select("db", "grp", "log_index", "hash"), ["db", "grp", "log_index"])
    known = changelog.register_snapshots(log, early.unionByName(files))
    return changelog.latest_snapshots(known).select(F.col("grp").alias("conv_id"), F.col("log_index").cast("long").alias("log_index"), "hash")


# definitions and the read path ---------------------------------------------------------------------------------------


@query("SELECT unnest(['create', 'again', 'update', 'stale', 'get', 'list', 'kind', 'rebuild', 'too soon', 'delete', 'gone']) AS step, unnest(['1', 'refused', '2', 'refused', '2', 'orders', 'refused', 'built', 'refused', 'ok', 'refused']) AS result")
def catalog_lifecycle(spark, sf):
    """A definition from its creation to its end."""
    import tempfile

    with tempfile.TemporaryDirectory() as at:  # the catalogue is a file of the driver
        c, rows = Catalog(f"{at}/catalog.json"), []

        def step(name, run):
            try:
                rows.append((name, str(run())))
            except (S.DefinitionError, S.QueryError):
                rows.append((name, "refused"))

        step("create", lambda: c.create(ORDERS))
        step("again", lambda: c.create(ORDERS))
        step("update", lambda: c.update(ORDERS, 1))
        step("stale", lambda: c.update(ORDERS, 1))
        step("get", lambda: c.get("orders")[1])
        step("list", lambda: ",".join(c.list()))
        step("kind", lambda: c.query("orders", "vector", lambda spec: "ran"))
        step("rebuild", lambda: c.rebuild("orders", lambda spec: "built"))
        step("too soon", lambda: c.rebuild("orders", lambda spec: "built"))
        step("delete", lambda: c.delete("orders", 2) or "ok")
        step("gone", lambda: c.get("orders"))
        return spark.createDataFrame(rows, "step string, result string")


@query("SELECT count(*) AS matches, sum(o_totalprice) IS NULL AS no_sum FROM orders WHERE FALSE")
def empty_index(spark, sf):
    """Facets and aggregates of an index without rows."""
    q = IndexQuery(facets=(compute.Facet("status"),), aggregates=(compute.Aggregate("total", "count"), compute.Aggregate("total", "sum")))
    out = search(ORDERS, orders(spark, sf).limit(0), q)
    return out.aggregates.crossJoin(out.facets["status"].agg(F.count("*").alias("buckets"))).select((F.col("count_total") + F.col("buckets")).alias("matches"), F.col("sum_total").isNull().alias("no_sum"))


@query("SELECT unnest(['range on status', 'facet on total', 'prefix on total', 'float for key', 'many values', 'bad page', 'text on orders', 'facets on paths']) AS what, 'refused' AS result")
def query_limits(spark, sf):
    """Queries that the definition, or a limit, doesn't allow."""
    rows, own = [], orders(spark, sf)
    spec = S.PathIndex("paths")
    cases = {
        "range on status": lambda: compile_predicate(Compare("status", "<", "x"), ORDERS),
        "facet on total": lambda: search(ORDERS, own, IndexQuery(facets=(compute.Facet("total"),))),
        "prefix on total": lambda: compile_predicate(Prefix("total", "1"), ORDERS),
        "float for key": lambda: decode_literal(ORDERS.field("key"), "1.5"),
        "many values": lambda: compile_predicate(In("status", tuple(map(str, range(65)))), ORDERS),
        "bad page": lambda: search(ORDERS, own, IndexQuery(limit=1001)),
        "text on orders": lambda: search(ORDERS, own, IndexQuery(text="x")),
        "facets on paths": lambda: search(spec, own, IndexQuery(facets=(compute.Facet("path"),))),
    }
    for name, run in cases.items():
        try:
            run()
            rows.append((name, "taken"))
        except S.QueryError:
            rows.append((name, "refused"))
    return spark.createDataFrame(rows, "what string, result string")


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice >= 123456.75")
def literals_from_json(spark, sf):
    """Literals as they come in a request: canonical JSON scalars of the field's type."""
    wanted = In("priority", tuple(decode_literal(ORDERS.field("priority"), x) for x in ('"1-URGENT"', '"5-LOW"')))
    least = Compare("total", ">=", decode_literal(ORDERS.field("total"), "123456.75"))
    return orders(spark, sf).filter(compile_predicate(wanted & least, ORDERS)).select(F.col("key").cast("long").alias("key"))


@query(f"SELECT {_O} AS path FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, 1 LIMIT 40 OFFSET 80")
def page_by_token(spark, sf):
    """The third page, by cursors that travel as signed tokens bound to the query."""
    q = IndexQuery(where=Equal("status", "O"), order=(("total", False),), limit=40)
    claims = order.Claims("tenant", "ann", "orders", ORDERS.fingerprint(), 1, order.query_hash(q), 1)
    rows, cursor = orders(spark, sf), None
    for _ in range(2):
        token = order.seal(search(ORDERS, rows, q, cursor=cursor).next_cursor(), claims, b"secret")
        cursor = order.unseal(token, claims, b"secret")
    return search(ORDERS, rows, q, cursor=cursor).hits.select("path")


@query("SELECT count(*) AS hits, 5 AS lag FROM orders WHERE o_orderstatus = 'P'")
def freshness_lag(spark, sf):
    """An index that lags behind answers, and says by how much."""
    q = IndexQuery(where=Equal("status", "P"), aggregates=(compute.Aggregate("total", "count"),))
    out = search(ORDERS, orders(spark, sf), q, freshness=Freshness(3, 10, 15))
    return out.aggregates.select(F.col("count_total").alias("hits"), F.lit(out.freshness.lag).alias("lag"))


@query("SELECT event_id AS id, event_type NOT IN ('error', 'signup', 'view') AS there FROM events")
def json_shapes(spark, sf):
    """An object where a scalar is due, or inside an array, makes a field missing; malformed sources leave no row."""
    body = F.when(F.col("event_type") == "error", '{"v": {"a": 1}}').when(F.col("event_type") == "signup", '{"v": [1, [2]]}').when(F.col("event_type") == "view", "{}").otherwise('{"v": [1, 2]}')
    spec = S.TypedJsonIndex("shapes", declared=(S.signed("v", C.FACET, source="/v", multi=True),))
    rows = project(spec, objects.as_objects(load(spark, sf, "events").select("event_id", "event_type"), padded("events", "event_id"), payload=body))
    return rows.select(F.substring_index("result_path", "/", -1).cast("long").alias("id"), F.col("v__present").alias("there"))


@query("SELECT event_id AS id, '{' NOT IN (event_type) AND event_type <> 'error' AS kept FROM events WHERE event_type <> 'error'")
def json_malformed(spark, sf):
    body = F.when(F.col("event_type") == "error", '{"k": ').otherwise('{"k": 1}')
    spec = S.TypedJsonIndex("ks", declared=(S.signed("k", C.EXACT, source="/k"),))
    rows = project(spec, objects.as_objects(load(spark, sf, "events").select("event_id", "event_type"), padded("events", "event_id"), payload=body))
    return rows.select(F.substring_index("result_path", "/", -1).cast("long").alias("id"), (F.col("k") == 1).alias("kept"))


@query("SELECT count(*) AS rows, 'refused' AS result FROM events")
def json_cardinality(spark, sf):
    """An array under a single-valued field breaks the definition."""
    spec = S.TypedJsonIndex("ks", declared=(S.signed("k", C.EXACT, source="/k"),))
    own = objects.as_objects(load(spark, sf, "events").select("event_id"), padded("events", "event_id"), payload=F.lit('{"k": [1, 2]}'))
    try:
        project(spec, own).agg(F.sum("k")).collect()
        result = "taken"
    except Exception as e:  # noqa: BLE001  Spark wraps what raise_error says
        result = "refused" if "holds one value" in str(e) else "failed"
    return own.agg(F.count("*").alias("rows")).withColumn("result", F.lit(result))


@query("SELECT p_partkey AS key, p_partkey % 5 IN (0, 4) AS ok FROM part")
def path_canonical(spark, sf):
    """Paths that an object may have."""
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("/"), k)).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("a//"), k)).when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("a/../"), k)).when(F.col("p_partkey") % 5 == 4, F.concat(F.lit("a/é/"), k)).otherwise(k)
    return load(spark, sf, "part").select(F.col("p_partkey").alias("key"), paths.canonical(path).alias("ok"))


@query("SELECT p_name, p_size FROM (SELECT p_name, p_size, ntile(4) OVER (ORDER BY p_name) AS t FROM part)")
def zip_archive_source(spark, sf):
    """Parts as JSON entries of ZIP archives, written and read again."""
    import io
    import zipfile

    import pandas as pd

    where = scratch.folder(spark, "zips")
    own = load(spark, sf, "part").select(F.to_json(F.struct("p_name", "p_size")).alias("j"), F.monotonically_increasing_id().alias("k"))

    def pack(parts):
        for part in parts:
            if len(part):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for k, j in zip(part["k"], part["j"]):
                        z.writestr(f"{k}.json", j)
                    z.writestr("read.me", "passed over")
                yield pd.DataFrame({"data": [data.getvalue()]})

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(where).getFileSystem(conf)
    for n, row in enumerate(own.repartition(4).mapInPandas(pack, "data binary").toLocalIterator()):  # one archive at a time
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{where}/{n}.zip"))
        out.write(bytes(row["data"]))
        out.close()
    found = objects.zip_records(spark, where).filter("problem is null")
    return found.select(F.from_json("payload", "p_name string, p_size int").alias("r")).select("r.p_name", "r.p_size")


@query("SELECT o_orderpriority AS partition, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY 1")
def shard_sink(spark, sf):
    """Compressed NDJSON shards by partition, written and read again."""
    where = scratch.folder(spark, "shards")
    objects.write_shards(load(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("partition")), where, rows_per_file=1000)
    return spark.read.schema("o_orderkey long, partition string").json(where).groupBy("partition").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT prefix, CAST(count(*) FILTER (o_orderstatus <> 'P') AS BIGINT) AS objects, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 15 ELSE 10 END) AS BIGINT) AS stored_bytes FROM (SELECT unnest(['', 'c' || CAST(o_custkey % 9 AS VARCHAR)]) AS prefix, o_orderstatus FROM orders) GROUP BY prefix")
def accounting_incremental(spark, sf):
    """A baseline, and then signed changes: finished orders grow, pending ones go but keep their bytes."""
    own = load(spark, sf, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 9).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), "o_orderstatus")
    wanted = spark.createDataFrame([("",), *[(f"c{k}",) for k in range(9)]], "prefix string")
    state = accounting.baseline(own.select("path", F.lit(1).alias("version"), F.lit(False).alias("deleted"), F.lit(10).cast("long").alias("length")), wanted)
    changes = own.filter("o_orderstatus <> 'O'").select("path", F.lit(True).alias("was_live"), (F.col("o_orderstatus") == "F").alias("is_live"), F.when(F.col("o_orderstatus") == "F", 5).otherwise(0).cast("long").alias("bytes_delta"))
    return accounting.apply(state, accounting.transitions(changes, wanted))


@query("SELECT prefix, CAST(count(*) AS BIGINT) AS objects FROM (SELECT unnest(['n' || CAST(c_nationkey AS VARCHAR)]) AS prefix FROM customer WHERE c_nationkey IN (1, 2)) GROUP BY 1")
def accounting_enabled(spark, sf):
    """Usage is counted under the prefixes that are enabled, and no longer under one that was disabled."""
    own = load(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string")).alias("path"), F.lit(1).alias("version"), F.lit(False).alias("deleted"), F.lit(1).alias("length"))
    wanted = spark.createDataFrame([], "prefix string")
    for prefix in ("n1", "n2", "n3"):
        wanted = accounting.enable(wanted, prefix)
    return accounting.baseline(own, accounting.disable(wanted, "n3")).select("prefix", "objects")


@query(f"SELECT {_path('events', 'event_id')} AS path, pushed, residual FROM events, (SELECT 'kind' AS pushed, 'k' AS residual) WHERE event_type = 'click' AND CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) < 5")
def scan_contract(spark, sf):
    """A scan tells which predicates it answers itself, and which are left to be tested on what it returns."""
    scan = plan(EVENTS, [Equal("kind", "click"), Compare("k", "<", 5)], stored={"kind"})
    return hits(scan.run(events(spark, sf)), F.lit(",".join(p.field for p in scan.exact)).alias("pushed"), F.lit(",".join(p.field for p in scan.residual)).alias("residual"))

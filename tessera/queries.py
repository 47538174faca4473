"""One query for each operator, over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import analysis, paths, vectors
from tessera.operators import authz, changelog, compute, gate, normalize, order, placement, postings, store
from tessera.operators.predicate import All, And, Compare, Equal, Exists, FullText, In, Not, Or, Phrase, Prefix, Range
from tessera.operators.postings import Postings
from tessera.operators.search import IndexQuery, join_results, search
from tessera.plans import schema as S
from tessera.plans.project import IDENTITY, project
from tessera.sources import objects, scratch
from tessera.streaming import accounting, journal

C = S.Capability
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _padded(prefix: str, key: str):
    return F.concat(F.lit(f"{prefix}/"), F.lpad(F.col(key).cast("string"), 12, "0"))


def _path(prefix: str, key: str) -> str:
    return f"'{prefix}/' || lpad(CAST({key} AS VARCHAR), 12, '0')"


_DAY = S.Expr("datediff(CAST(o_orderdate AS DATE), DATE'1970-01-01')")
_SQL_DAY = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"

ORDERS = S.TypedJsonIndex(
    "orders",
    declared=(
        S.keyword("status", C.EXACT, C.PREFIX, C.FACET, C.ORDER, source=S.Expr("o_orderstatus")),
        S.keyword("priority", C.EXACT, C.PREFIX, C.RANGE, C.FACET, C.ORDER, source=S.Expr("o_orderpriority")),
        S.signed("day", C.EXACT, C.RANGE, C.ORDER, C.FACET, C.AGGREGATE, source=_DAY),
        S.unsigned("key", C.EXACT, C.RANGE, C.ORDER, C.AGGREGATE, source=S.Expr("o_orderkey")),
        S.signed("customer", C.EXACT, C.RANGE, C.ORDER, C.FACET, C.AGGREGATE, source=S.Expr("o_custkey")),
        S.double("total", C.EXACT, C.RANGE, C.ORDER, C.AGGREGATE, source=S.Expr("o_totalprice")),
    ),
)
PARTS = S.TypedJsonIndex(
    "parts",
    declared=(
        S.keyword("name", C.EXACT, C.PREFIX, C.RANGE, C.ORDER, source=S.Expr("p_name")),
        S.keyword("brand", C.EXACT, C.PREFIX, C.RANGE, C.FACET, C.ORDER, source=S.Expr("p_brand")),
        S.keyword("type", C.EXACT, C.PREFIX, C.FACET, source=S.Expr("p_type")),
        S.signed("size", C.EXACT, C.RANGE, C.ORDER, C.FACET, C.AGGREGATE, source=S.Expr("p_size")),
        S.double("price", C.RANGE, C.ORDER, C.AGGREGATE, source=S.Expr("p_retailprice")),
    ),
)
# events, with an explicit null for errors' values and no value at all for sign-ups
EVENTS = S.TypedJsonIndex(
    "events",
    declared=(
        S.keyword("kind", C.EXACT, C.FACET, source="/kind"),
        S.double("value", C.EXACT, C.RANGE, C.ORDER, C.FACET, C.AGGREGATE, source="/value"),
        S.signed("k", C.EXACT, C.RANGE, C.ORDER, C.FACET, C.AGGREGATE, source="/props/k"),
    ),
)
LINES = S.TypedJsonIndex(
    "lines",
    declared=(
        S.keyword("flags", C.EXACT, C.FACET, source=S.Expr("flags"), multi=True),
        S.signed("quantities", C.EXACT, C.RANGE, C.FACET, C.AGGREGATE, source=S.Expr("quantities"), multi=True),
        S.double("prices", C.AGGREGATE, source=S.Expr("prices"), multi=True),
    ),
)


def _kind():
    return F.col("event_type")


def orders(spark, sf):
    return project(ORDERS, objects.as_objects(load(spark, sf, "orders"), _padded("orders", "o_orderkey")))


def parts(spark, sf):
    return project(PARTS, objects.as_objects(load(spark, sf, "part"), _padded("parts", "p_partkey")))


def events(spark, sf):
    value = F.when(_kind() == "error", F.lit("null")).otherwise(F.round("value", 2).cast("string"))
    pair = F.when(_kind() == "signup", F.lit("")).otherwise(F.concat(F.lit(', "value": '), value))
    payload = F.concat(F.lit('{"kind": "'), _kind(), F.lit('"'), pair, F.lit(', "props": '), F.col("props"), F.lit("}"))
    df = load(spark, sf, "events").select("event_id", "event_type", "props", "value", payload.alias("_p"))
    return project(EVENTS, objects.as_objects(df.drop("value"), _padded("events", "event_id"), payload=F.col("_p")))


def lines(spark, sf):
    own = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"), F.collect_list(F.col("l_quantity").cast("long")).alias("quantities"), F.collect_list("l_extendedprice").alias("prices"))
    return project(LINES, objects.as_objects(own, _padded("orders", "l_orderkey")))


def hits(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("result_path").alias("path"), *more)


# predicates ----------------------------------------------------------------------------------------------------

_O, _P, _E = _path("orders", "o_orderkey"), _path("parts", "p_partkey"), _path("events", "event_id")


def _predicate(name: str, spec, rows, p, sql: str) -> None:
    from tessera.operators.predicate import compile_predicate

    query(sql, name)(lambda spark, sf: hits(rows(spark, sf).filter(compile_predicate(p, spec))))


for _name, _p, _where in [
    ("pred_equal", Equal("status", "F"), "o_orderstatus = 'F'"),
    ("pred_in", In("priority", ("1-URGENT", "2-HIGH", "no such")), "o_orderpriority IN ('1-URGENT', '2-HIGH', 'no such')"),
    ("pred_lt", Compare("total", "<", 50000.0), "o_totalprice < 50000"),
    ("pred_le", Compare("day", "<=", 9000), f"{_SQL_DAY} <= 9000"),
    ("pred_gt", Compare("total", ">", 200000.0), "o_totalprice > 200000"),
    ("pred_ge", Compare("key", ">=", 100), "o_orderkey >= 100"),
    ("pred_range", Range("total", 10000.0, 20000.0), "o_totalprice >= 10000 AND o_totalprice < 20000"),
    ("pred_exists", Exists("priority"), "TRUE"),
    ("pred_not", Not(Equal("status", "O")), "NOT coalesce(o_orderstatus = 'O', FALSE)"),
    ("pred_or", Or((Equal("status", "P"), Compare("total", ">=", 300000.0))), "o_orderstatus = 'P' OR o_totalprice >= 300000"),
    ("pred_and", And((Equal("status", "O"), In("priority", ("5-LOW",)), Compare("customer", "<", 500))), "o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AND o_custkey < 500"),
    ("pred_all", All(), "TRUE"),
]:
    _predicate(_name, ORDERS, orders, _p, f"SELECT {_O} AS path FROM orders WHERE {_where}")
_predicate("pred_prefix", PARTS, parts, Prefix("brand", "Brand#1"), f"SELECT {_P} AS path FROM part WHERE starts_with(p_brand, 'Brand#1')")
_predicate("pred_null_equal", EVENTS, events, Equal("value", None), f"SELECT {_E} AS path FROM events WHERE event_type = 'error'")
_predicate("pred_not_exists", EVENTS, events, Not(Exists("value")), f"SELECT {_E} AS path FROM events WHERE event_type = 'signup'")
_predicate("pred_bounds_skip_null", EVENTS, events, Compare("value", "<=", 50.0), f"SELECT {_E} AS path FROM events WHERE event_type NOT IN ('error', 'signup') AND round(value, 2) <= 50")
_predicate("json_typed_range", EVENTS, events, Range("k", 10, 20), f"SELECT {_E} AS path FROM events WHERE CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) >= 10 AND CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) < 20")
_LINES_SQL = f"(SELECT {_path('orders', 'l_orderkey')} AS path, list(l_returnflag) AS flags, list(CAST(l_quantity AS BIGINT)) AS quantities, list(l_extendedprice) AS prices FROM lineitem GROUP BY l_orderkey)"
_predicate("pred_multi_any", LINES, lines, And((Equal("flags", "R"), Compare("quantities", ">", 45))), f"SELECT path FROM {_LINES_SQL} WHERE list_contains(flags, 'R') AND list_max(quantities) > 45")
_predicate("pred_multi_same_element", LINES, lines, Range("quantities", 10, 12), f"SELECT path FROM {_LINES_SQL} WHERE len(list_filter(quantities, lambda x: x >= 10 AND x < 12)) > 0")


@query(f"SELECT {_E} AS path, event_type AS kind, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE round(value, 2) END AS value, event_type <> 'signup' AS present, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_pointer_cells(spark, sf):
    return hits(events(spark, sf), "kind", "value", F.col("value__present").alias("present"), "k")


# paths and metadata ----------------------------------------------------------------------------------------------



def _doc_path():
    return F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))


_DOC = "'docs/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0')"


def documents(spark, sf, *more):
    return objects.as_objects(load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", *more), _doc_path())


@query(f"SELECT {_DOC} AS path FROM documents WHERE starts_with({_DOC}, 'docs/d') ORDER BY 1 LIMIT 100")
def path_prefix_list(spark, sf):
    spec = S.PathIndex("paths")
    return search(spec, project(spec, documents(spark, sf)), IndexQuery(prefix="docs/d")).hits.select("path")


@query(f"SELECT {_DOC} AS path FROM documents WHERE starts_with({_DOC}, 'docs/en/') AND {_DOC} > 'docs/en/00000050' ORDER BY 1 LIMIT 20")
def path_start_after(spark, sf):
    spec = S.PathIndex("paths", S.Scope("docs"))
    return search(spec, project(spec, documents(spark, sf)), IndexQuery(prefix="docs/en/", start_after="docs/en/00000050", limit=20)).hits.select("path")


@query(f"SELECT {_DOC} AS path, n_chars AS content_length FROM documents WHERE n_chars > 2000 AND starts_with({_DOC}, 'docs/e')")
def metadata_filter(spark, sf):
    from tessera.operators.predicate import compile_predicate

    spec = S.MetadataIndex("meta", names=("path", "content_type", "content_length"))
    rows = project(spec, documents(spark, sf).withColumn("content_length", F.col("n_chars")))
    return hits(rows.filter(compile_predicate(Compare("content_length", ">", 2000) & Prefix("path", "docs/e") & Equal("content_type", "application/json"), spec)), F.col("content_length").cast("long").alias("content_length"))


@query(f"SELECT {_DOC} AS path, starts_with({_DOC}, 'docs/en/') AS below, {_DOC} = 'docs/en' AS same FROM documents WHERE starts_with({_DOC}, 'docs/en/')")
def scope_segment_prefix(spark, sf):
    spec = S.PathIndex("paths", S.Scope("docs/en"))
    path = F.col("result_path")
    return hits(project(spec, documents(spark, sf)), paths.segment_prefix(path, F.lit("docs/en")).alias("below"), (path == "docs/en").alias("same"))


@query(f"SELECT {_DOC} AS path FROM documents WHERE starts_with({_DOC}, 'docs/f') AND {_DOC} > 'docs/fr/00000003' ORDER BY 1 LIMIT 31")
def list_page(spark, sf):
    return objects.list_objects(documents(spark, sf), "docs/f", "docs/fr/00000003", 30).select("path")


@query(f"SELECT {_DOC} AS path FROM documents ORDER BY 1")
def list_merge_sources(spark, sf):
    own = documents(spark, sf)
    return objects.merge_sources([own.filter(F.col("doc_id") % 3 == k) for k in range(3)]).select("path").orderBy("path")


_WANTED = [f"orders/{k:012d}" for k in (7, 3, 99999999, 32, 1, 3)]


@query("SELECT r.ordinal, r.path, o.o_orderkey IS NOT NULL AS found FROM (VALUES " + ", ".join(f"({k}, '{p}')" for k, p in enumerate(_WANTED)) + f") r(ordinal, path) LEFT JOIN orders o ON {_O} = r.path")
def batch_get_ordered(spark, sf):
    return objects.batch_get(spark, objects.as_objects(load(spark, sf, "orders"), _padded("orders", "o_orderkey")), _WANTED).select("ordinal", "path", "found")


@query("SELECT 'users/1' AS path, CASE WHEN count(*) = 0 THEN 'never' WHEN arg_max(event_type, event_id) = 'error' THEN 'deleted' ELSE 'present' END AS state FROM events WHERE user_id = 1")
def point_read(spark, sf):
    return objects.point_read(spark, objects.current_heads(_user_versions(spark, sf)), "users/1").select("path", "state")


@query("SELECT event_id AS version, event_type = 'error' AS deleted FROM events WHERE user_id = 5 ORDER BY 1")
def version_history(spark, sf):
    return objects.history(_user_versions(spark, sf), "users/5").select(F.col("version").cast("long").alias("version"), "deleted")


@query("SELECT unnest(['', 'region', 'region/' || r_name, 'region/' || r_name || '/' || n_name]) AS prefix, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def prefix_enumeration(spark, sf):
    own = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return own.select(F.explode(paths.prefixes(F.concat_ws("/", F.lit("region"), "r_name", "n_name"))).alias("prefix"), "n_nationkey")


# order and pages -------------------------------------------------------------------------------------------------


def _order_sql(order_by: str, limit: int, where: str = "TRUE") -> str:
    return f"SELECT {_O} AS path FROM orders WHERE {where} ORDER BY {order_by}, 1 LIMIT {limit}"


@query(_order_sql("o_orderpriority ASC, o_totalprice DESC", 200))
def order_multi_key(spark, sf):
    return search(ORDERS, orders(spark, sf), IndexQuery(order=(("priority", False), ("total", True)), limit=200)).hits.select("path")


@query(f"WITH e AS (SELECT {_E} AS path, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 2 ELSE 1 END AS s, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE round(value, 2) END AS v FROM events), r AS (SELECT path, row_number() OVER (ORDER BY s, v, path) AS up, row_number() OVER (ORDER BY s DESC, v DESC, path) AS down FROM e) SELECT 'up' AS side, up AS rank, path FROM r WHERE up <= 1000 UNION ALL SELECT 'down', down, path FROM r WHERE down <= 1000")
def order_missing_null(spark, sf):
    """The largest pages in both directions."""
    rows = events(spark, sf)

    def side(name, descending):
        ks = order.keys(EVENTS, (("value", descending),))
        page = order.page(rows, ks, 1000)  # what is ranked is one page
        return hits(page.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order.sort_columns(ks)))), F.lit(name).alias("side"), "rank")

    return side("up", False).union(side("down", True)).select("side", "rank", "path")


@query(_order_sql("o_totalprice", 100))
def topk_arbitrary(spark, sf):
    return search(ORDERS, orders(spark, sf), IndexQuery(order=(("total", False),))).hits.select("path")


@query(f"SELECT path FROM (SELECT {_O} AS path, o_orderdate, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY CAST(o_orderdate AS DATE) DESC, o_custkey, 1 LIMIT 50 OFFSET 50)")
def page_two_keyset(spark, sf):
    q = IndexQuery(where=Equal("status", "O"), order=(("day", True), ("customer", False)), limit=50)
    rows = orders(spark, sf)
    return search(ORDERS, rows, q, cursor=search(ORDERS, rows, q).next_cursor()).hits.select("path")


INCIDENT = And((Equal("status", "O"), In("priority", ("1-URGENT", "2-HIGH", "3-MEDIUM")), Compare("total", ">", 150000.0)))
_INCIDENT = "o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_totalprice > 150000"


@query(f"SELECT {_O} AS path FROM orders WHERE {_INCIDENT} ORDER BY {_SQL_DAY} DESC, o_orderkey LIMIT 4")
def incident_query(spark, sf):
    return search(ORDERS, orders(spark, sf), IndexQuery(where=INCIDENT, order=(("day", True), ("key", False)), limit=4)).hits.select("path")


@query(f"SELECT {_O} AS path FROM orders WHERE {_INCIDENT} AND o_totalprice < -1")
def incident_no_hit(spark, sf):
    return search(ORDERS, orders(spark, sf), IndexQuery(where=INCIDENT & Compare("total", "<", -1.0), order=(("day", True), ("key", False)), limit=4)).hits.select("path")


@query(f"SELECT count(*) AS count_total, round(sum(o_totalprice), 2) AS sum_total, round(avg(o_totalprice), 4) AS avg_total, min({_SQL_DAY}) AS min_day, max({_SQL_DAY}) AS max_day FROM orders WHERE {_INCIDENT}")
def incident_computations(spark, sf):
    wanted = tuple(compute.Aggregate(f, op) for f, op in [("total", "count"), ("total", "sum"), ("total", "avg"), ("day", "min"), ("day", "max")])
    out = search(ORDERS, orders(spark, sf), IndexQuery(where=INCIDENT, aggregates=wanted)).aggregates
    return out.select("count_total", F.round("sum_total", 2).alias("sum_total"), F.round("avg_total", 4).alias("avg_total"), "min_day", "max_day")


# facets and aggregates -------------------------------------------------------------------------------------------


def _facet(rows, spec, field, limit=1000, where=All()):
    return search(spec, rows, IndexQuery(where=where, facets=(compute.Facet(field, limit),))).facets[field].select("value", "count")


@query("SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1")
def facet_keyword(spark, sf):
    return _facet(parts(spark, sf), PARTS, "brand")


@query(f"SELECT v AS value, count(*) AS count FROM (SELECT unnest(list_distinct(flags)) AS v FROM {_LINES_SQL}) GROUP BY 1")
def facet_multi_distinct(spark, sf):
    return _facet(lines(spark, sf), LINES, "flags")


@query("SELECT CAST(p_size AS BIGINT) AS value, count(*) AS count FROM part WHERE starts_with(p_brand, 'Brand#2') GROUP BY 1")
def facet_numeric(spark, sf):
    return _facet(parts(spark, sf), PARTS, "size", where=Prefix("brand", "Brand#2"))


@query("SELECT CAST(o_custkey AS BIGINT) AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def facet_limit_ties(spark, sf):
    return _facet(orders(spark, sf), ORDERS, "customer", 15)


@query("SELECT CASE WHEN event_type = 'error' THEN NULL ELSE round(value, 2) END AS value, count(*) AS count FROM events WHERE event_type <> 'signup' GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 5")
def facet_null_bucket(spark, sf):
    return _facet(events(spark, sf), EVENTS, "value", 5)


def _aggregate(rows, spec, *wanted):
    return search(spec, rows, IndexQuery(aggregates=tuple(compute.Aggregate(f, op) for f, op in wanted))).aggregates


@query("SELECT count(CASE WHEN event_type NOT IN ('error', 'signup') THEN value END) AS count_value FROM events")
def agg_count(spark, sf):
    return _aggregate(events(spark, sf), EVENTS, ("value", "count")).select("count_value")


@query("SELECT min(o_custkey) AS min_customer, min(o_totalprice) AS min_total FROM orders")
def agg_min(spark, sf):
    return _aggregate(orders(spark, sf), ORDERS, ("customer", "min"), ("total", "min")).select("min_customer", "min_total")


@query("SELECT max(o_custkey) AS max_customer, max(o_totalprice) AS max_total FROM orders")
def agg_max(spark, sf):
    return _aggregate(orders(spark, sf), ORDERS, ("customer", "max"), ("total", "max")).select("max_customer", "max_total")


@query(f"SELECT CAST(sum(o_custkey) AS BIGINT) AS sum_customer, CAST(sum({_SQL_DAY}) AS BIGINT) AS sum_day FROM orders")
def agg_sum_int(spark, sf):
    return _aggregate(orders(spark, sf), ORDERS, ("customer", "sum"), ("day", "sum")).select("sum_customer", "sum_day")


@query("SELECT round(sum(o_totalprice), 1) AS sum_total FROM orders")
def agg_sum_float(spark, sf):
    return _aggregate(orders(spark, sf), ORDERS, ("total", "sum")).select(F.round("sum_total", 1).alias("sum_total"))


@query("SELECT round(CAST(sum(o_custkey) AS DOUBLE) / count(o_custkey), 6) AS avg_customer, round(avg(o_totalprice), 4) AS avg_total FROM orders")
def agg_avg(spark, sf):
    return _aggregate(orders(spark, sf), ORDERS, ("customer", "avg"), ("total", "avg")).select(F.round("avg_customer", 6).alias("avg_customer"), F.round("avg_total", 4).alias("avg_total"))


@query("SELECT count(*) AS count_quantities, min(CAST(l_quantity AS BIGINT)) AS min_quantities, max(CAST(l_quantity AS BIGINT)) AS max_quantities, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_quantities, round(avg(CAST(l_quantity AS BIGINT)), 6) AS avg_quantities FROM lineitem")
def agg_multi_values(spark, sf):
    out = _aggregate(lines(spark, sf), LINES, *[("quantities", op) for op in compute.OPS])
    return out.select("count_quantities", "min_quantities", "max_quantities", "sum_quantities", F.round("avg_quantities", 6).alias("avg_quantities"))


@query("SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def latency_nearest_rank(spark, sf):
    return normalize.nearest_rank(load(spark, sf, "events"), "value", [0.5, 0.95, 0.99], ["event_type"]).withColumn("mean", F.round("mean", 6))


# text ------------------------------------------------------------------------------------------------------------

_TOKENS = "list_filter(list_transform(regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: lower(x)), lambda x: x <> '')"
_DOC_TOKENS = f"(SELECT doc_id, {_DOC} AS path, {_TOKENS.format('text')} AS t FROM documents)"
BODY = S.FullTextIndex("body", declared=(S.text("body", source=S.Expr("text")),))


def bodies(spark, sf):
    return project(BODY, documents(spark, sf, "text"))


_BUILT: dict[tuple, Postings] = {}


def built(spark, sf, spec, rows) -> Postings:
    """The postings of an index: built when an application first asks, read from then on."""
    key = (spark.sparkContext.applicationId, sf, spec.fingerprint())
    if key not in _BUILT:
        _BUILT[key] = Postings.build(rows(spark, sf), spec, scratch.folder(spark, "postings"))
    return _BUILT[key]


@query(f"SELECT path FROM {_DOC_TOKENS} WHERE list_contains(t, 'the') AND list_contains(t, 'of') AND list_contains(t, 'from')")
def text_all_terms(spark, sf):
    own = built(spark, sf, BODY, bodies)
    return hits(own.rows(own.matching("The OF, from")))


@query(f"SELECT path FROM {_DOC_TOKENS} WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0")
def text_phrase(spark, sf):
    own = built(spark, sf, BODY, bodies)
    return hits(own.rows(own.matching("of the", phrase=True)))


@query(f"SELECT path FROM {_DOC_TOKENS} WHERE list_contains(t, 'the') AND NOT list_contains(t, 'of') AND len(list_filter(range(1, len(t)), lambda i: t[i] = 'and' AND t[i + 1] = 'the')) = 0")
def text_predicates(spark, sf):
    """The same as predicates, which read the texts themselves and so go with any others."""
    from tessera.operators.predicate import compile_predicate

    return hits(bodies(spark, sf).filter(compile_predicate(FullText("body", "the") & Not(FullText("body", "of")) & Not(Phrase("body", "and the")), BODY)))


def _bm25_sql(words: list[str], fields: str, limit: int, tokens: str) -> str:
    """BM25 over (path, field, t): statistics by field, every query word in every field."""
    values = ", ".join(f"({k}, '{w}')" for k, w in enumerate(words))
    return f"""
WITH d AS ({tokens}), n AS (SELECT count(DISTINCT path) AS n FROM d),
fs AS (SELECT field, count(*) FILTER (len(t) > 0) AS docs, sum(len(t)) AS total FROM d GROUP BY field),
q AS (SELECT * FROM (VALUES {values}) v(k, w)),
tf AS (SELECT d.path, d.field, q.k, q.w, len(list_filter(d.t, lambda x: x = q.w)) AS tf, greatest(len(d.t), 1) AS len FROM d, q),
df AS (SELECT field, w, count(DISTINCT path) AS df FROM tf WHERE tf > 0 GROUP BY field, w),
hit AS (SELECT path FROM tf WHERE tf > 0 GROUP BY path HAVING count(DISTINCT k) = {len(words)}),
s AS (SELECT tf.path, sum(ln(1 + greatest(n.n - df.df + 0.5, 0) / (df.df + 0.5)) * (tf.tf * 2.2) / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * tf.len / greatest(1.0, fs.total / fs.docs)))) AS score
  FROM tf JOIN df USING (field, w) JOIN fs USING (field) JOIN hit USING (path) CROSS JOIN n WHERE tf.tf > 0 GROUP BY tf.path)
SELECT path, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 4) AS score FROM s ORDER BY CAST(score AS FLOAT) DESC, path LIMIT {limit}"""


def _rounded():
    return F.round(F.col("score").cast("double"), 4).alias("score")


RANKED = [order.Key("score", True), *map(order.Key, IDENTITY)]


@query(_bm25_sql(["the", "of", "and"], "", 10, f"SELECT path, 'body' AS field, t FROM {_DOC_TOKENS}"))
def text_bm25_top10(spark, sf):
    found = postings.search_text(built(spark, sf, BODY, bodies), "the of and", 10)
    return order.page(found, RANKED, 10).select(F.col("result_path").alias("path"), _rounded())


def talk(spark, sf):
    return project(TALK, objects.as_objects(load(spark, sf, "conversations"), F.concat(_padded("talk", "conv_id"), F.lit("/"), F.col("turn").cast("string"))))


TALK = S.FullTextIndex("talk", declared=(S.text("said", source=S.Expr("text")), S.text("who", source=S.Expr("role"))))
_TALK = "'talk/' || lpad(CAST(conv_id AS VARCHAR), 12, '0') || '/' || CAST(turn AS VARCHAR)"


@query(_bm25_sql(["the", "user"], "", 25, f"SELECT {_TALK} AS path, 'said' AS field, {_TOKENS.format('text')} AS t FROM conversations UNION ALL SELECT {_TALK}, 'who', {_TOKENS.format('role')} FROM conversations"))
def text_bm25_multifield(spark, sf):
    return order.page(postings.search_text(built(spark, sf, TALK, talk), "the USER", 25), RANKED, 25).select(F.col("result_path").alias("path"), _rounded())


@query(f"SELECT w AS token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS w FROM {_DOC_TOKENS}) GROUP BY 1")
def text_term_stats(spark, sf):
    return built(spark, sf, BODY, bodies).table("terms").select("token", "tf", "df")


@query(_bm25_sql(["the", "of"], "", 10, f"SELECT path, 'body' AS field, t FROM {_DOC_TOKENS}"))
def text_bm25_scan(spark, sf):
    """Ranked search without postings, over the texts themselves."""
    return search(BODY, bodies(spark, sf), IndexQuery(text="the of", limit=10)).hits.select("path", _rounded())


@query(f"SELECT page_id, len({_TOKENS.format('html')}) AS n FROM pages")
def text_tokens(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.size(analysis.tokens(F.col("html"))).cast("long").alias("n"))


# vectors ---------------------------------------------------------------------------------------------------------

_Q = [((i * 37) % 64 - 32) / 32.0 for i in range(64)]
_SQL_Q = "list_transform(range(64), lambda i: CAST((i * 37) % 64 - 32 AS DOUBLE) / 32)"
_SQL_VEC = _path("vec", "vec_id")
_SQL_V = "CAST(embedding AS DOUBLE[])"


def _vector(spark, sf, metric, normalize=False, limit=10):
    spec = S.VectorIndex("vec", source=S.Expr("embedding"), dims=64, metric=metric, normalize=normalize)
    rows = project(spec, objects.as_objects(load(spark, sf, "embeddings"), _padded("vec", "vec_id")))
    return search(spec, rows, IndexQuery(vector=tuple(_Q), limit=limit)).hits.select("path", _rounded())


def _vector_sql(score: str) -> str:
    return f"SELECT {_SQL_VEC} AS path, round(CAST(CAST({score} AS FLOAT) AS DOUBLE), 4) AS score FROM embeddings ORDER BY CAST({score} AS FLOAT) DESC, 1 LIMIT 10"


@query(_vector_sql(f"list_cosine_similarity({_SQL_V}, {_SQL_Q})"))
def vector_cosine(spark, sf):
    return _vector(spark, sf, S.Metric.COSINE)


@query(_vector_sql(f"list_dot_product({_SQL_V}, {_SQL_Q})"))
def vector_dot(spark, sf):
    return _vector(spark, sf, S.Metric.DOT)


@query(_vector_sql(f"-list_distance({_SQL_V}, {_SQL_Q})"))
def vector_euclid(spark, sf):
    return _vector(spark, sf, S.Metric.EUCLID)


@query(_vector_sql(f"list_dot_product({_SQL_V}, {_SQL_Q}) / sqrt(list_dot_product({_SQL_V}, {_SQL_V})) / sqrt(list_dot_product({_SQL_Q}, {_SQL_Q}))"))
def vector_l2_normalized(spark, sf):
    return _vector(spark, sf, S.Metric.DOT, True)


HYBRID = S.HybridIndex("hybrid", source=S.Expr("embedding"), dims=64, metric=S.Metric.COSINE, declared=(S.text("body", source=S.Expr("text")),), text_weight=0.5)


def hybrid_rows(spark, sf):
    own = load(spark, sf, "documents").join(load(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "lang", "text", "embedding")
    return project(HYBRID, objects.as_objects(own, _doc_path()))


def _hybrid(spark, sf, fusion):
    near = vectors.score(F.col("vector"), vectors.query_vector(_Q, HYBRID.dims, HYBRID.normalize), HYBRID.metric)
    found = postings.search_hybrid(built(spark, sf, HYBRID, hybrid_rows), hybrid_rows(spark, sf), "the from", near, fusion)
    return order.page(found, RANKED, 20).select(F.col("result_path").alias("path"), _rounded())


def _hybrid_sql(union: bool) -> str:
    lexical = _bm25_sql(["the", "from"], "", 1 << 30, f"SELECT path, 'body' AS field, t FROM {_DOC_TOKENS} WHERE doc_id IN (SELECT vec_id FROM embeddings)").rsplit("SELECT path, round", 1)[0]
    score = f"0.5 * coalesce(s.score, 0) + list_cosine_similarity({_SQL_V}, {_SQL_Q})"
    return f"{lexical} SELECT v.path, round(CAST(CAST({score} AS FLOAT) AS DOUBLE), 4) AS score FROM (SELECT {_DOC} AS path, embedding FROM documents JOIN embeddings ON doc_id = vec_id WHERE len({_TOKENS.format('text')}) > 0) v {'LEFT' if union else ''} JOIN s ON s.path = v.path ORDER BY CAST({score} AS FLOAT) DESC, v.path LIMIT 20"


@query(_hybrid_sql(False))
def hybrid_and(spark, sf):
    return _hybrid(spark, sf, "and")


@query(_hybrid_sql(True))
def hybrid_union(spark, sf):
    return _hybrid(spark, sf, "union")


# manifests -------------------------------------------------------------------------------------------------------


@query("SELECT 'packs/' || CAST(p_partkey % 10 AS VARCHAR) AS path, 'src/' || p_brand || '/' || CAST(p_partkey AS VARCHAR) AS tree_path FROM part WHERE p_size % 3 = 1 AND starts_with(p_brand, 'Brand#3') ORDER BY 2 LIMIT 100")
def git_tree_prefix(spark, sf):
    from tessera.operators.predicate import compile_predicate

    spec = S.GitIndex("git", repository="repo")
    key = F.col("p_partkey").cast("string")
    record = F.struct(F.lit("repo").alias("repository_id"), F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")).alias("commit_id"), F.concat_ws("/", F.lit("src"), "p_brand", key).alias("tree_path"), F.sha2(key, 256).alias("object_id"), F.concat(F.lit("packs/"), (F.col("p_partkey") % 10).cast("string")).alias("pack_path"), F.lit(1).alias("pack_version"), F.lit(0).alias("offset"), F.lit(10).alias("length"))
    rows = project(spec, objects.as_objects(load(spark, sf, "part"), _padded("manifests", "p_partkey"), payload=F.to_json(F.array(record))))
    found = rows.filter(compile_predicate(Equal("commit_id", "c1") & Prefix("tree_path", "src/Brand#3"), spec))
    return order.page(found, order.keys(spec, spec.default_order), 100).select(F.col("result_path").alias("path"), "tree_path")


@query("SELECT 'blobs/' || CAST(label AS VARCHAR) AS path, 'layer.' || CAST(vec_id AS VARCHAR) AS tensor_name FROM embeddings WHERE vec_id = 42")
def tensor_lookup(spark, sf):
    spec = S.TensorIndex("tensors", model="m")
    record = F.struct(F.lit("m").alias("model_id"), F.concat(F.lit("layer."), F.col("vec_id").cast("string")).alias("tensor_name"), F.concat(F.lit("blobs/"), F.col("label").cast("string")).alias("source_path"), F.lit(3).alias("source_version"), F.lit(0).alias("offset"), F.lit(256).alias("length"), F.lit("f32").alias("dtype"), F.array(F.lit(64)).alias("shape"))
    rows = project(spec, objects.as_objects(load(spark, sf, "embeddings"), _padded("manifests", "vec_id"), payload=F.to_json(record)))
    found = search(spec, rows, IndexQuery(tensor="layer.42"))
    return found.matches.select(F.col("result_path").alias("path"), "tensor_name")


# versions and mutations ------------------------------------------------------------------------------------------


def _user_versions(spark, sf):
    return load(spark, sf, "events").select(F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("version"), (_kind() == "error").alias("deleted"), F.round(F.col("value") * 100).cast("long").alias("length"))


@query("SELECT 'users/' || CAST(user_id AS VARCHAR) AS path, max(event_id) AS version FROM events GROUP BY user_id")
def latest_version_per_path(spark, sf):
    return objects.current_heads(_user_versions(spark, sf)).select("path", "version")


@query("SELECT 'users/' || CAST(user_id AS VARCHAR) AS path, max(event_id) AS version FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def tombstone_subtract(spark, sf):
    return objects.live(objects.current_heads(_user_versions(spark, sf))).select("path", "version")


def _mutations(spark, sf):
    mode = F.when(_kind() == "error", "delete").when(_kind().isin("view", "signup"), "put_if_absent").otherwise("put")
    return load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("command_id"), F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), mode.alias("mode"), F.lit(None).cast("long").alias("expected"), F.col("props").alias("content_hash"))


@query("""
WITH m AS (SELECT event_id AS seq, user_id, event_type, coalesce(lag(event_type) OVER w <> 'error', FALSE) AS live FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
o AS (SELECT *, CASE WHEN event_type = 'error' THEN CASE WHEN live THEN 'applied' ELSE 'not_found' END WHEN event_type IN ('view', 'signup') AND live THEN 'precondition_failed' ELSE 'applied' END AS outcome FROM m)
SELECT seq, outcome, CAST(count(*) FILTER (outcome = 'applied') OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS version FROM o""")
def mutation_fold_cas(spark, sf):
    return store.fold(_mutations(spark, sf)).select("seq", "outcome", F.coalesce("version", F.lit(0)).alias("version"))


@query("SELECT event_id AS seq, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN event_type = first(event_type) OVER w THEN 'replay' ELSE 'conflict' END AS receipt FROM events WINDOW w AS (PARTITION BY user_id % 50, user_id ORDER BY event_id)")
def mutation_receipts(spark, sf):
    own = load(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("command_id"), _kind().alias("fingerprint"))
    return store.receipts(own).select("seq", "receipt")


@query("SELECT 's' || CAST(user_id % 4 AS VARCHAR) AS source, o AS offset, path FROM (SELECT user_id, 'users/' || CAST(user_id AS VARCHAR) AS path, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS o FROM events) WHERE o >= 10 AND o < 100")
def journal_page(spark, sf):
    source = F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string"))
    own = load(spark, sf, "events").select(source.alias("source"), (F.row_number().over(Window.partitionBy(F.col("user_id") % 4).orderBy("event_id")) - 1).cast("long").alias("offset"), F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").cast("decimal(20,0)").alias("version"), F.lit(False).alias("deleted"), F.col("event_id").alias("commit_id"))
    return _users_page(own)


def _users_page(own):
    page, _ = journal.read_page(own, {f"s{k}": 10 for k in range(4)}, {f"s{k}": 100 for k in range(4)}, "users")
    return page.select("source", "offset", "path")


# authorisation ---------------------------------------------------------------------------------------------------

GRAPH = authz.AuthzSchema(
    {
        "user": authz.Namespace({}),
        "region": authz.Namespace({"member": [("user", "")]}),
        "nation": authz.Namespace({"viewer": [("user", ""), ("region", "member")]}, {"view": [authz.Inherit("viewer")]}),
        "customer": authz.Namespace({"parent": [("nation", "")], "viewer": [("region", "member")]}, {"view": [authz.Inherit("viewer"), authz.Through("parent", "view")]}),
        "order": authz.Namespace({"parent": [("customer", "")]}, {"view": [authz.Through("parent", "view")]}),
    }
)


def _edges(df, namespace, oid, relation, s_ns, sid, s_rel=""):
    return df.select(F.lit(namespace).alias("namespace"), F.col(oid).cast("string").alias("object_id"), F.lit(relation).alias("relation"), F.lit(s_ns).alias("subject_namespace"), F.col(sid).cast("string").alias("subject_id"), F.lit(s_rel).alias("subject_relation"))


def graph(spark, sf):
    """ann views nation 3; bob is a member of region 1, whose members view its nations."""
    fixed = spark.createDataFrame([("nation", "3", "viewer", "user", "ann", ""), ("region", "1", "member", "user", "bob", "")], authz.TUPLE)
    out = fixed.union(_edges(load(spark, sf, "customer"), "customer", "c_custkey", "parent", "nation", "c_nationkey"))
    out = out.union(_edges(load(spark, sf, "orders"), "order", "o_orderkey", "parent", "customer", "o_custkey"))
    return out.union(_edges(load(spark, sf, "nation"), "nation", "n_nationkey", "viewer", "region", "n_regionkey", "member"))


def _who(spark, *names):
    return spark.createDataFrame([("user", n) for n in names], "subject_namespace string, subject_id string")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS nation, 'bob' AS subject FROM nation WHERE n_regionkey = 1 UNION SELECT '3', 'ann'")
def authz_userset_expand(spark, sf):
    have = authz.expand(GRAPH, graph(spark, sf).filter("namespace in ('nation', 'region')"), _who(spark, "ann", "bob"))
    return have.filter("namespace = 'nation' and name = 'view'").select(F.col("object_id").alias("nation"), F.col("s_id").alias("subject"))


_BOB = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, 'bob' AS subject FROM orders WHERE {_BOB} UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'ann' FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3")
def authz_tuple_to_userset(spark, sf):
    have = authz.expand(GRAPH, graph(spark, sf), _who(spark, "ann", "bob"))
    return have.filter("namespace = 'order' and name = 'view'").select(F.col("object_id").alias("id"), F.col("s_id").alias("subject"))


@query(f"SELECT {_O} AS path FROM orders WHERE {_BOB} AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, 1 LIMIT 25")
def gate_authorized_hits(spark, sf):
    have = authz.expand(GRAPH, graph(spark, sf), _who(spark, "bob")).filter("namespace = 'order' and name = 'view'")
    allowed = have.select(F.concat(F.lit("orders/"), F.lpad("object_id", 12, "0")).alias("path"))
    q = IndexQuery(where=Equal("priority", "1-URGENT"), order=(("total", True),), limit=25)
    return search(ORDERS, orders(spark, sf), q, allowed=allowed).hits.select("path")


@query(f"SELECT {_O} AS path FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0")
def gate_current_versions(spark, sf):
    from tessera.operators.predicate import compile_predicate

    own = load(spark, sf, "orders")
    heads = own.select(_padded("orders", "o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("version"), F.lit(False).alias("deleted"))
    return hits(gate.current(orders(spark, sf).filter(compile_predicate(Equal("status", "F"), ORDERS)), heads))


# accounting, logs, normalisation, placement ------------------------------------------------------------------------

_ACCOUNT = "SELECT r_name, n_name, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS length FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


@query(f"SELECT prefix, CAST(count(*) AS BIGINT) AS objects, CAST(sum(length) AS BIGINT) AS stored_bytes FROM (SELECT unnest(['', r_name, r_name || '/' || n_name]) AS prefix, length FROM ({_ACCOUNT})) GROUP BY prefix")
def accounting_prefix_rollup(spark, sf):
    own = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(load(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(load(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    versions = own.select(F.concat_ws("/", "r_name", "n_name", "c_custkey", "o_orderkey").alias("path"), F.lit(1).alias("version"), F.lit(False).alias("deleted"), F.round(F.col("o_totalprice") * 100).cast("long").alias("length"))
    places = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    wanted = places.select(F.explode(F.array(F.lit(""), F.col("r_name"), F.concat_ws("/", "r_name", "n_name"))).alias("prefix"))
    return accounting.baseline(versions, wanted)


@query("SELECT prefix, CAST(sum(i) AS BIGINT) AS bytes_in, CAST(sum(o) AS BIGINT) AS bytes_out FROM (SELECT unnest(['', 'u' || CAST(user_id % 7 AS VARCHAR)]) AS prefix, CAST(round(value) AS BIGINT) AS i, 1 AS o FROM events) GROUP BY prefix")
def accounting_traffic(spark, sf):
    own = load(spark, sf, "events").select(F.col("event_id").alias("batch_id"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"), F.lit("/"), F.col("user_id").cast("string")).alias("path"), F.round("value").cast("long").alias("bytes_in"), F.lit(1).alias("bytes_out"))
    wanted = spark.createDataFrame([("",), *[(f"u{k}",) for k in range(7)]], "prefix string")
    return accounting.traffic(own.union(own.filter("batch_id % 2 = 0")), wanted)


@query("""
WITH RECURSIVE t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
c AS (SELECT conv_id, i, sha256('|' || text) AS h FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.i, sha256(c.h || '|' || t.text) FROM t JOIN c ON t.conv_id = c.conv_id AND t.i = c.i + 1)
SELECT conv_id, count(*) AS entries, arg_max(h, i) AS hash, TRUE AS ok FROM c GROUP BY conv_id""")
def changelog_chain_check(spark, sf):
    return changelog.verify(conversation_log(spark, sf)).groupBy(F.col("grp").alias("conv_id")).agg(F.count("*").alias("entries"), F.max_by("hash", "log_index").alias("hash"), F.every("ok").alias("ok"))


def conversation_log(spark, sf):
    """Each conversation as a hash-linked log."""
    turns = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    start = F.array().cast("array<struct<previous:string,hash:string,payload:string>>")

    def step(log, x):
        before = F.when(F.size(log) > 0, F.get(log, F.size(log) - 1)["hash"])
        return F.concat(log, F.array(F.struct(before.alias("previous"), changelog.entry_hash(before, x["text"]).alias("hash"), x["text"].alias("payload"))))

    return turns.select("conv_id", F.posexplode(F.aggregate("t", start, step)).alias("log_index", "e")).select(F.lit("db").alias("db"), F.col("conv_id").alias("grp"), "log_index", "e.*")


@query("""
WITH p AS (SELECT 'P' || CAST(page_id AS VARCHAR) AS id, page_id FROM pages)
SELECT id, 'pypi' AS ecosystem, 'my-pkg-' || CAST(page_id % 7 AS VARCHAR) AS package, 2 AS affected FROM p
UNION ALL SELECT id, 'npm', 'lib' || CAST(page_id % 3 AS VARCHAR), 1 FROM p
UNION ALL SELECT id, 'unscoped', id, 1 FROM p WHERE page_id % 5 = 0""")
def normalize_group_explode(spark, sf):
    k = lambda n: (F.col("page_id") % n).cast("string")
    item = lambda eco, name: F.struct(F.struct(eco.cast("string").alias("ecosystem"), name.cast("string").alias("name")).alias("package"), F.array(F.lit("1.0")).alias("versions"))
    items = F.array(item(F.lit(" PyPI"), F.concat(F.lit("My_Pkg."), k(7))), item(F.lit("pypi"), F.concat(F.lit("my-pkg__"), k(7))), item(F.lit("NPM"), F.concat(F.lit("Lib"), k(3))))
    items = F.when(F.col("page_id") % 5 == 0, F.concat(items, F.array(item(F.lit(None), F.lit("x"))))).otherwise(items)
    own = load(spark, sf, "pages").select(F.concat(F.lit(" P"), F.col("page_id").cast("string")).alias("id"), F.lit("2024-05-06T00:00:00Z").alias("modified"), F.lit(None).cast("string").alias("withdrawn"), F.array(F.lit(" a "), F.lit("a"), F.lit("")).alias("aliases"), items.alias("affected"))
    return normalize.records(own).select("id", "ecosystem", "package", F.col("affected").cast("int").alias("affected"))


@query("""
WITH n AS (SELECT n_name AS node, 1 + n_regionkey AS weight FROM nation), k AS (SELECT c_custkey AS key FROM customer),
s AS (SELECT key, node, weight / -log2((CAST(('0x' || left(sha256(CAST(key AS VARCHAR) || '|' || node), 13)) AS BIGINT) + 0.5) / 4503599627370496) AS score FROM k, n)
SELECT key, rank, node FROM (SELECT key, node, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, node) AS INTEGER) AS rank FROM s) WHERE rank <= 3""")
def placement_rank(spark, sf):
    nodes = load(spark, sf, "nation").select(F.col("n_name").alias("node"), (F.col("n_regionkey") + 1).alias("weight"))
    return placement.rank(load(spark, sf, "customer").select(F.col("c_custkey").alias("key")), nodes)


# extensions ------------------------------------------------------------------------------------------------------


@query(f"SELECT {_O} AS path, o_orderkey AS key, o_totalprice AS right_total FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 250000")
def ext_join_results(spark, sf):
    from tessera.operators.predicate import compile_predicate

    rows = orders(spark, sf)
    side = lambda p, *c: rows.filter(compile_predicate(p, ORDERS)).select(F.col("result_path").alias("path"), F.col("result_version").alias("version"), *c)
    out = join_results(side(Equal("status", "O"), F.col("key").cast("long").alias("key")), side(Compare("total", ">", 250000.0), "total"))
    return out.select("path", "key", "right_total")


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS count FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube_facets(spark, sf):
    return compute.cube(orders(spark, sf), ORDERS, ["status", "priority"]).select("status", "priority", "count")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_window(spark, sf):
    own = load(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return own.select(F.col("w.start").alias("start"), "event_type", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session_window(spark, sf):
    own = load(spark, sf, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("w.start").alias("start"), "n")


# the other half registers itself in the same tables
from tessera import system_queries as system_queries  # noqa: E402

"""The read path: an index query to one DataFrame of hits, with facets, aggregates, a page token and freshness."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import compute, gate, order, ranking
from tessera.operators.predicate import All, Equal, Predicate, Prefix, compile_predicate
from tessera.plans.project import IDENTITY
from tessera.plans.schema import FullTextIndex, GitIndex, HybridIndex, IndexSpec, PathIndex, QueryError, TensorIndex, TypedJsonIndex, VectorIndex

DEFAULT_LIMIT, MOST_LIMIT = 100, 1000


@dataclass(frozen=True)
class IndexQuery:
    """What to find. Text, phrase and vector rank; prefix and start_after are for path indices."""

    where: Predicate = field(default_factory=All)
    order: tuple[tuple[str, bool], ...] = ()
    limit: int = 0
    text: str | None = None
    phrase: bool = False
    vector: tuple[float, ...] | None = None
    fusion: str = "and"
    prefix: str | None = None
    start_after: str | None = None
    commit: str | None = None
    tree_path: str | None = None
    tensor: str | None = None
    facets: tuple[compute.Facet, ...] = ()
    aggregates: tuple[compute.Aggregate, ...] = ()


@dataclass(frozen=True)
class Freshness:
    """How far the rows have come; lag never fails a query."""

    generation: int = 0
    indexed_offset: int = 0
    observed_offset: int = 0

    @property
    def lag(self) -> int:
        return max(0, self.observed_offset - self.indexed_offset)


@dataclass
class QueryResult:
    hits: DataFrame
    matches: DataFrame
    keys: list[order.Key]
    limit: int
    facets: dict[str, DataFrame]
    aggregates: DataFrame | None
    freshness: Freshness

    def next_cursor(self) -> dict | None:
        """Where the next page starts; given whenever this page is full, even if nothing follows."""
        names = list(dict.fromkeys(c for k in self.keys for c in (k.column, k.state) if c))
        last = order.page(self.matches, self.keys, self.limit).select(*names).collect() if self.limit <= MOST_LIMIT else []
        return order.cursor_of(self.keys, last[-1]) if len(last) == self.limit else None


def page_limit(limit: int) -> int:
    if not 0 <= limit <= MOST_LIMIT:
        raise QueryError(f"the limit is 0 to {MOST_LIMIT}")
    return limit or DEFAULT_LIMIT


def _kind_filter(spec: IndexSpec, q: IndexQuery) -> Predicate:
    out = q.where
    if isinstance(spec, GitIndex):
        if q.commit is not None:
            out = out & Equal("commit_id", q.commit)
        if q.tree_path is not None:
            out = out & Equal("tree_path", q.tree_path)
        if q.prefix:
            out = out & Prefix("tree_path", q.prefix)
    elif isinstance(spec, TensorIndex):
        if q.tensor is not None:
            out = out & Equal("tensor_name", q.tensor)
    elif isinstance(spec, PathIndex):
        if q.prefix:
            out = out & Prefix("path", q.prefix)
    elif q.prefix is not None or q.start_after is not None:
        raise QueryError(f"a {spec.kind} query has no prefix")
    if (q.commit or q.tree_path) and not isinstance(spec, GitIndex) or q.tensor and not isinstance(spec, TensorIndex):
        raise QueryError(f"not a {spec.kind} query")
    return out


def search(spec: IndexSpec, rows: DataFrame, q: IndexQuery, heads: DataFrame | None = None, allowed: DataFrame | None = None, cursor: dict | None = None, freshness: Freshness | None = None) -> QueryResult:
    """Compile and gate a query over the rows of an index. Nothing runs but the text statistics, until hits are read."""
    spec.validate()
    limit = page_limit(q.limit)
    if (q.facets or q.aggregates) and not isinstance(spec, TypedJsonIndex):
        raise QueryError("facets and aggregates need a typed index")
    compute.validate(spec, q.facets, q.aggregates)
    ranked = False
    found = rows
    if isinstance(spec, HybridIndex):
        found, ranked = ranking.search_hybrid(rows, spec, q.text or "", list(q.vector) if q.vector else None, q.fusion), True
    elif isinstance(spec, VectorIndex):
        if q.vector is None or q.text is not None:
            raise QueryError("a vector query has a vector")
        found, ranked = ranking.search_vector(rows, spec, list(q.vector)), True
    elif isinstance(spec, FullTextIndex) and q.text is not None:
        found, ranked = ranking.search_text(rows, spec, q.text, q.phrase), True
    elif q.text is not None or q.vector is not None:
        raise QueryError(f"a {spec.kind} query has no text or vector")
    found = found.filter(compile_predicate(_kind_filter(spec, q), spec))
    if q.start_after is not None:
        found = found.filter(F.col("path") > q.start_after)
    if heads is not None:
        found = gate.current(found, heads)
    if allowed is not None:
        found = gate.authorized(found, allowed)
    if ranked and q.order:
        raise QueryError("a ranked query is ordered by its score")
    ks = [order.Key("score", True), *order.keys(spec, ())] if ranked else order.keys(spec, q.order or spec.default_order)
    hits = order.page(found, ks, limit, cursor)
    shown = hits.select(F.col("result_path").alias("path"), F.col("result_version").alias("version"), *([F.col("score")] if ranked else []))
    facets = {f.field: compute.facet(found, spec, f) for f in q.facets}
    aggregates = compute.aggregate(found, spec, q.aggregates) if q.aggregates else None
    behind = found if cursor is None else found.filter(order.after(ks, cursor))
    return QueryResult(shown, behind, ks, limit, facets, aggregates, freshness or Freshness())


def join_results(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Extension: two result sets on the identity that both share."""
    return left.join(right.withColumnsRenamed({c: f"right_{c}" for c in right.columns if c not in ("path", "version")}), ["path", "version"], how)


__all__ = ["Freshness", "IDENTITY", "IndexQuery", "QueryResult", "join_results", "page_limit", "search"]

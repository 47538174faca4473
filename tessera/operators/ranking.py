"""Ranked search: BM25 over text fields, vector scores, and their weighted sum."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import analysis, vectors
from tessera.plans.project import IDENTITY, words
from tessera.plans.schema import FullTextIndex, HybridIndex, QueryError, VectorIndex


def _flat(name: str) -> Column:
    return F.flatten(words(name))


def _tf(name: str, token: str) -> Column:
    return F.size(F.filter(_flat(name), lambda t: t == token)).cast("double")


def text_stats(rows: DataFrame, spec: FullTextIndex | HybridIndex, names: list[str], wanted: list[str]):
    """Documents, and per field documents with it, total length and documents with each token: one pass, one row."""
    some = {n: F.size(_flat(n)) > 0 for n in names}
    parts = [F.count("*").cast("double").alias("n")]
    for a, n in enumerate(names):
        parts += [F.count(F.when(some[n], 1)).alias(f"docs_{a}"), F.sum(F.size(_flat(n)).cast("long")).alias(f"length_{a}")]
        parts += [F.count(F.when(F.array_contains(_flat(n), t), 1)).alias(f"df_{a}_{b}") for b, t in enumerate(dict.fromkeys(wanted))]
    return rows.agg(*parts).first()


def term_stats(rows: DataFrame, names: list[str]) -> DataFrame:
    """(field, token, tf, df) of the whole index."""
    each = [rows.select(F.lit(n).alias("field"), F.struct(*IDENTITY).alias("doc"), F.explode(_flat(n)).alias("token")) for n in names]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    per_doc = out.groupBy("field", "doc", "token").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("field", "token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def matches(names: list[str], wanted: list[str], phrase: bool) -> Column:
    """Every token in some field; a phrase within one field."""
    if not phrase:
        return analysis.has_all(F.concat(*map(_flat, names)), wanted)
    out = F.lit(False)
    for n in names:
        out = out | F.exists(words(n), lambda w: analysis.has_phrase(w, wanted))
    return out


def bm25(names: list[str], wanted: list[str], stats, k1: float, b: float) -> Column:
    """The sum over every occurrence of a query token and every field that has it; a token asked for twice counts twice."""
    total = F.lit(0.0)
    order = list(dict.fromkeys(wanted))
    for t, times in Counter(wanted).items():
        for a, n in enumerate(names):
            df = float(stats[f"df_{a}_{order.index(t)}"])
            average = max(1.0, (stats[f"length_{a}"] or 0) / max(1, stats[f"docs_{a}"]))
            idf = F.log(F.lit(1.0 + max(stats["n"] - df + 0.5, 0.0) / (df + 0.5)))
            tf, length = _tf(n, t), F.greatest(F.size(_flat(n)), F.lit(1)).cast("double")
            term = idf * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * length / average))
            total = total + F.when(tf > 0, term * float(times)).otherwise(0.0)
    return total


def search_text(rows: DataFrame, spec: FullTextIndex | HybridIndex, text: str, phrase: bool = False, names: list[str] | None = None) -> DataFrame:
    """Matching rows with their score. The statistics are those of all rows, seen or not."""
    names = names or [f.name for f in spec.fields]
    wanted = analysis.query_tokens(text)
    if not wanted:
        raise QueryError("the text holds no token")
    stats = text_stats(rows, spec, names, wanted)
    hit = matches(names, wanted, phrase)
    if len(names) == 1 and not spec.field(names[0]).multi:
        hit = analysis.may_hold(F.col(names[0]), wanted) & hit
    found = rows.filter(F.coalesce(hit, F.lit(False)))
    return found.withColumn("score", bm25(names, wanted, stats, spec.k1, spec.b).cast("float"))


def search_vector(rows: DataFrame, spec: VectorIndex, vector: list[float]) -> DataFrame:
    """All rows with their score."""
    q = vectors.query_vector(vector, spec.dims, spec.normalize)
    return rows.withColumn("score", vectors.score(F.col("vector"), q, spec.metric).cast("float"))


def search_hybrid(rows: DataFrame, spec: HybridIndex, text: str, vector: list[float] | None, fusion: str = "and") -> DataFrame:
    """Weighted sum of both scores. The text filters (fusion="and"), or only adds to the score (fusion="union")."""
    if fusion not in ("and", "union"):
        raise QueryError(f"no fusion {fusion!r}")
    names = [f.name for f in spec.fields]
    wanted = analysis.query_tokens(text or "")
    if not wanted and vector is None:
        raise QueryError("a hybrid query has a text or a vector")
    tw, vw = spec.weights
    lexical = F.lit(0.0)
    if wanted:
        lexical = bm25(names, wanted, text_stats(rows, spec, names, wanted), spec.k1, spec.b)
        hit = F.coalesce(matches(names, wanted, False), F.lit(False))
        if fusion == "and":
            rows = rows.filter(hit)
        else:
            lexical = F.when(hit, lexical).otherwise(0.0)
    near = F.lit(0.0)
    if vector is not None:
        near = vectors.score(F.col("vector"), vectors.query_vector(vector, spec.dims, spec.normalize), spec.metric)
    return rows.withColumn("score", (lexical * tw + near * vw).cast("float"))

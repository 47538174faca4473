"""URL filters: fixed host rules, and association rules mined from labelled URLs.

A labelled URL is a transaction of its tokens (host labels and their parts, path segments, query keys) and its class.
Tokens under the least support are left out first. Tokens that stand in exactly the same transactions are one item, a
class of tokens: sets of them would differ in nothing but the choice of names, and a long URL that stands often has
2^n of those. Items that stand in every transaction are left out, as no confidence depends on them. Spark's FP-growth
finds the frequent item sets of what is left; rules that lead to the blocked class are kept if their support (a share
of the labelled pages and a number of them) and confidence reach the bounds, and dropped if a smaller rule with at
least their confidence covers them. A URL has an item if it has one of its tokens.

Rules match by inverted index: a rule is filed under its rarest item, so a URL only meets the rules of its items. The
index travels with the tasks while it has at most ``MOST_RULES`` rules; more of them are joined on that item instead.

Defined results: a null URL, or one without ``://``, has an empty host and path and no tokens, so only the default
(allow) holds; a missing label is no label; of several labels of a page the worst counts; without rules, or without
labelled pages, the method allows everything; rows that repeat a page are judged one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, map_batches, table

#: The host rules of the contract, as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Production parameters: share and number of the labelled pages that a token set needs, confidence of a rule, labelled pages that are mined at most, rules that travel with the tasks at most.
SUPPORT, LEAST_PAGES, CONFIDENCE, MINED_ROWS, MOST_RULES = 0.004, 4, 0.5, 500_000, 100_000
BLOCKED, ALLOWED = "=block", "=allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<verdict, rule> of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def tokens(url: str | None) -> set[str]:
    """Tokens of a URL; their first letter tells where they stand."""
    at = (url or "").find("://")
    if at < 0:
        return set()
    rest = url[at + 3 :].lower()
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path, _, query = rest[len(host) :].split("#", 1)[0].partition("?")
    labels = [x for x in host.split(".") if x]
    out = {f"h:{x}" for x in labels} | {f"h:{y}" for x in labels for y in x.split("-") if y}
    out |= {f"p:{x}" for x in re.split(r"[/._-]+", path) if x and not x.isdigit()}
    return out | {f"q:{x.split('=', 1)[0]}" for x in query.split("&") if x}


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, rows: int = MINED_ROWS, least: int = LEAST_PAGES, scratch: Scratch | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Rules (items array<string>, support, confidence) for the blocked class, from the labelled pages, and the item of each token.

    At most about ``rows`` pages are mined, those with the least hash of their id. A token that takes part stands in a
    share of ``support`` of them, so their number is at most the mean number of tokens divided by it.
    """
    from pyspark.ml.fpm import FPGrowth

    scratch = scratch or Scratch(pages.sparkSession)
    worst = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max("toxic").alias("toxic"))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).join(worst, "page_id")
    n = known.count()
    share = min(1.0, rows / n) if n else 1.0
    known = known.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            own = [sorted(tokens(u)) for u in batch.column("url").to_pylist()]
            names = [uuid.uuid4().int >> 65 for _ in own]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(own, pa.list_(pa.string())), batch.column("toxic")], names=["t", "tokens", "toxic"])

    baskets = scratch.save(map_batches(known.select("url", F.col("toxic").cast("int").alias("toxic")), run, "t long, tokens array<string>, toxic int"))
    n = baskets.count()
    fewest = max(least, math.ceil(support * n))
    # two sums of hashes tell sets of transactions apart
    sign = lambda salt: F.sum(F.xxhash64("t", F.lit(salt)).cast("decimal(38,0)"))
    often = baskets.select("t", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), sign(1).alias("s1"), sign(2).alias("s2")).filter(F.col("n") >= fewest)
    classes: dict[tuple, list[str]] = {}
    for r in often.collect():  # at most the mean number of tokens / support
        if r["n"] < n:
            classes.setdefault((r["n"], r["s1"], r["s2"]), []).append(r["token"])
    item = {t: min(own) for own in classes.values() for t in own}

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({item[t] for t in ts if t in item}) + [BLOCKED if x else ALLOWED] for ts, x in zip(batch.column("tokens").to_pylist(), batch.column("toxic").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], names=["items"])

    transactions = map_batches(baskets.select("tokens", "toxic"), rename, "items array<string>")
    # a hair less than the bound, so that sets of just that number count
    rules = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (fewest - 0.5) / n)) if n else 1.0, minConfidence=confidence).fit(transactions).associationRules
    return rules.filter(F.element_at("consequent", 1) == BLOCKED).select(F.array_sort("antecedent").alias("items"), "support", "confidence"), item


class RuleIndex:
    """Rules by their rarest item, and the item of each token."""

    def __init__(self, rules: list[tuple[list[str], float]], item: dict[str, str] | None = None):
        count: dict[str, int] = {}
        for items, _ in rules:
            for t in items:
                count[t] = count.get(t, 0) + 1
        self.item = item if item is not None else {t: t for t in count}
        self.by_item: dict[str, list[tuple[frozenset[str], float]]] = {}
        for items, sure in sorted(((frozenset(i), c) for i, c in rules), key=lambda r: (len(r[0]), -r[1], sorted(r[0]))):
            # smaller rules come first
            if not any(k <= items and c >= sure for t in items for k, c in self.by_item.get(t, ())):
                self.by_item.setdefault(min(items, key=lambda t: (count[t], t)), []).append((items, sure))

    def blocks(self, own: set[str]) -> bool:
        items = {self.item[t] for t in own if t in self.item}
        return any(k <= items for t in items for k, _ in self.by_item.get(t, ()))


def joined(pages: DataFrame, rules: DataFrame, item: dict[str, str]) -> DataFrame:
    """page_id, url and mined, by a join of the URLs' items with the rules filed under them; for rules too many to travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted({item[t] for t in tokens(u) if t in item}) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(own, pa.list_(pa.string()))], names=["url", "own"])

    urls = map_batches(pages.select("url").filter("url is not null").distinct(), run, "url string, own array<string>")
    count = rules.select(F.explode("items").alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    filed = rules.select("items", F.explode("items").alias("at")).join(count, "at").groupBy("items").agg(F.min(F.struct("n", "at")).alias("x")).select("items", "x.at")
    hit = urls.select("url", "own", F.explode("own").alias("at")).join(filed, "at").filter(F.size(F.array_except("items", "own")) == 0).select("url").distinct()
    return pages.join(hit.withColumn("mined", F.lit(True)), "url", "left").select("page_id", "url", F.coalesce("mined", F.lit(False)).alias("mined"))


def judge(pages: DataFrame, index: RuleIndex | tuple[DataFrame, dict[str, str]], rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (whether an association rule blocks the URL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [index.blocks(tokens(u)) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(hit, pa.bool_())], names=["page_id", "url", "mined"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    mined = map_batches(own, run, "page_id long, url string, mined boolean") if isinstance(index, RuleIndex) else joined(own, *index)
    out = mined.select("page_id", host.alias("host"), path.alias("path"), "mined")
    out = out.withColumn("r", host_rule(F.col("host"), F.col("path"), rules))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")


def build_index(pages: DataFrame, labels: DataFrame, most: int = MOST_RULES, **params) -> RuleIndex | tuple[DataFrame, dict[str, str]]:
    """The index that travels with the tasks or, of more than ``most`` rules, the rules themselves."""
    scratch = Scratch(pages.sparkSession)
    found, item = mine(pages, labels, scratch=scratch, **params)
    found = scratch.save(found)
    if found.count() > most:
        return found, item
    return RuleIndex([(r["items"], r["confidence"]) for r in found.collect()], item)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, build_index(pages, table(spark, sf_dir, "labels")))

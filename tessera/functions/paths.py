"""Paths and prefixes as columns. Three notions of prefix are kept apart: scope, literal and segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH_BYTES = 4096


def in_scope(path: Column, prefix: str) -> Column:
    """Index scope: empty means all, a trailing slash is literal, else the path itself or something below it."""
    if not prefix:
        return F.lit(True)
    return path.startswith(prefix) if prefix.endswith("/") else segment_prefix(path, F.lit(prefix))


def segment_prefix(path: Column, prefix: Column) -> Column:
    """Watch, accounting and policy prefixes: everything under the empty one, else equal or a child."""
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def has_segment(path: Column, segment: str) -> Column:
    return F.array_contains(F.split(path, "/"), segment)


def canonical(path: Column) -> Column:
    """Whether an object may have this path."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda s: s.isin("", ".", ".."))
    return F.coalesce((path != "") & (F.octet_length(path) <= PATH_BYTES) & ~bad & ~path.rlike(r"[\x00-\x1F\x7F]"), F.lit(False))


def prefixes(path: Column) -> Column:
    """The empty prefix, every prefix that ends before a slash, and the path itself."""
    parts = F.split(path, "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), upto))

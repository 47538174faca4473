"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is removed if an earlier one (by doc_id, hash of the text, place in the text) is equal to it, or within one edit
(insertion, deletion or substitution of a character) where both have at least LEAST characters. Equal lines meet by
a 128-bit hash and are one row from then on. For the rest, hashed keys of deletion variants are joined:

* equal length: (place, line without that character); all lines with such a key are within one edit of each other;
* one longer: the line itself meets the longer lines that are equal to it without one of their characters.

Emitting every variant of every line would cost the square of its length, so two lossless sieves come first. One
edit leaves the first or the last p characters of both lines as they are (p at most half the shorter one), and it
lies in one block of a fixed grid, outside of which both agree. Only lines that share a key of the first sieve and
then of the second go on, and only with the variants inside the shared block. A key's group is summed up by its
earliest line, never by its pairs; the lines found are then compared with that witness by edit distance.

Every text is split once for each use of its lines, and work is linear in the number of lines.

Defined results: blank lines stay and are never compared; a null text or id stays as it is; a document that has
nothing left keeps its row with an empty text; a row is told by its doc_id and text, so rows with both equal keep the
same lines, and of rows with one doc_id and different texts the one with the least hash of the text comes first;
empty tables give empty tables. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fresh, table

#: Production parameters: fewest characters for a near match, and the edit bound (1; 0 compares for equality alone).
LEAST, EDITS = 16, 1


def _split(text: Column) -> Column:
    return F.split(text, "\n")


def _blank(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s", "")) == ""


def _power(n: Column) -> Column:
    """The largest power of two up to n, at least 1."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n.cast("double"), F.lit(1.0))))).cast("int")


def _half(n: Column) -> Column:
    return _power(F.floor(n / 2))


def _grid(n: Column) -> Column:
    """Block length for a shorter line of n characters: 8 to 16 blocks a line."""
    return _power(F.floor(n / 8))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and text: what tells rows apart, and their lines."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))


def _split_once(rows: DataFrame) -> DataFrame:
    """The rows with their ``lines`` in place of the text. The generator keeps the optimiser from splitting again at every use."""
    others = [c for c in rows.columns if c != "text"]
    return rows.select(*others, F.explode(F.array(_split(F.col("text")))).alias("lines"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, pos, line for every line that isn't blank."""
    own = _rows(docs).filter("doc_id is not null").select("doc_id", "th", F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    return own.filter(~_blank(F.col("line")))


def _id(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")]


def _sieve(line: Column, n: Column) -> Column:
    """Keys of the first sieve: both ends, as long as half of this line and of one a character shorter."""
    ends = lambda p: F.array(F.xxhash64(F.lit("left"), p, F.left(line, p)), F.xxhash64(F.lit("right"), p, F.right(line, p)))
    return F.when(n >= LEAST, F.when(_half(n) == _half(n - 1), ends(_half(n))).otherwise(F.concat(ends(_half(n)), ends(_half(n - 1)))))


def _blocks(line: Column, n: Column, base: Column) -> Column:
    """Keys of the second sieve: the line without block b, if the shorter of two lines has ``base`` characters."""
    size = _grid(base)
    key = lambda b: F.xxhash64(base, b, F.left(line, b * size), F.right(line, F.greatest(base - (b + 1) * size, F.lit(0))))
    return F.transform(F.sequence(F.lit(0), F.floor(base / size).cast("int")), lambda b: F.struct(base.alias("base"), b.alias("b"), key(b).alias("key")))


def _variants(line: Column, n: Column, base: Column, b: Column) -> Column:
    """(role, key) of the deletion variants inside block b, and the line itself."""
    size = _grid(base)
    places = F.sequence((b * size).cast("int"), F.greatest(F.least((b + 1) * size, n) - 1, b * size).cast("int"))
    cut = lambda x: (F.left(line, x), F.substring(line, x + 2, n))
    same = F.transform(places, lambda x: F.struct(F.lit("same").alias("role"), F.xxhash64(F.lit("same"), x, *cut(x)).alias("key")))
    whole = F.array(F.struct(F.lit("self").alias("role"), F.xxhash64(F.lit("less"), line).alias("key")))
    longer = F.transform(places, lambda x: F.struct(F.lit("longer").alias("role"), F.xxhash64(F.lit("less"), F.concat(*cut(x))).alias("key")))
    return F.when(base == n, F.concat(same, whole)).otherwise(longer)


def _shared(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """The rows whose key stands in more than one row. The keys are written first: the join then deals both sides, and Spark can split a hot key."""
    hot = scratch.save(rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key))
    return rows.join(hot, key, "left_semi")


def near_lines(firsts: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(h1, h2) of the distinct lines that an earlier one is within one edit of."""
    keyed = firsts.select("doc_id", "th", "pos", F.explode("sieve").alias("key"))
    met = _shared(keyed, "key", scratch).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("at"))
    own = _split_once(_rows(docs).filter("doc_id is not null").join(met, ["doc_id", "th"]))
    wanted = F.explode(F.transform("at", lambda k: F.struct(k.alias("pos"), F.try_element_at(F.col("lines"), k + 1).alias("line"))))
    line = own.select("doc_id", "th", wanted.alias("x")).select("doc_id", "th", "x.pos", "x.line").filter("line is not null")
    # rows that repeat an id and a text tell the same lines again
    known = scratch.save(line.select(*_id(F.col("line")), "doc_id", "th", "pos", "line", F.length("line").alias("n")).dropDuplicates(["h1", "h2"]))

    text, n = F.col("line"), F.col("n")
    both = F.concat(_blocks(text, n, n), _blocks(text, n, n - 1))
    coarse = known.select("h1", "h2", F.explode(both).alias("k")).select("h1", "h2", "k.base", "k.b", "k.key")
    blocks = scratch.save(_shared(coarse, "key", scratch).select("h1", "h2", "base", "b").distinct())
    fine = known.join(blocks, ["h1", "h2"]).select("h1", "h2", "doc_id", "th", "pos", F.explode(_variants(text, n, F.col("base"), F.col("b"))).alias("v"))
    fine = scratch.save(fine.select("h1", "h2", "doc_id", "th", "pos", "v.role", "v.key").distinct())

    me = F.struct("doc_id", "th", "pos", "h1", "h2")
    of = lambda role: F.min(F.when(F.col("role") == role, me)).alias(f"first_{role}")
    least = scratch.save(fine.groupBy("key").agg(of("same"), of("self"), of("longer")).filter("first_same is not null or (first_self is not null and first_longer is not null)"))
    witness = F.when(F.col("role") == "same", F.col("first_same")).when(F.col("role") == "self", F.col("first_longer")).otherwise(F.col("first_self"))
    pairs = fine.join(least, "key").withColumn("w", witness).filter(F.col("w").isNotNull() & (F.struct("w.doc_id", "w.th", "w.pos") < F.struct("doc_id", "th", "pos")))
    pairs = pairs.select("h1", "h2", F.col("w.h1").alias("g1"), F.col("w.h2").alias("g2")).distinct()
    other = known.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("earlier"))
    checked = pairs.join(known.select("h1", "h2", "line"), ["h1", "h2"]).join(other, ["g1", "g2"])
    return checked.filter(F.levenshtein("line", "earlier", EDITS) >= 0).select("h1", "h2").distinct()


def kept_lines(docs: DataFrame, edits: int = EDITS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, th and the places (from 0) of the lines that stay, blank ones left out; rows without such a line are not in it."""
    if edits not in (0, 1):
        raise ValueError("the edit bound is 0 or 1")
    scratch = scratch or Scratch(docs.sparkSession)
    line = F.col("line")
    keyed = _lines(docs).select(*_id(line), "doc_id", "th", "pos", _sieve(line, F.length(line)).alias("sieve"))
    # the sieve's keys follow from the line, so any row's will do
    firsts = keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("f"), F.first("sieve").alias("sieve"))
    firsts = scratch.save(firsts.select("h1", "h2", "f.doc_id", "f.th", "f.pos", "sieve"))
    stay = firsts.join(scratch.save(near_lines(firsts, docs, scratch)), ["h1", "h2"], "left_anti") if edits else firsts
    return stay.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("kept"))


def _places(lines: Column, keep) -> Column:
    at = F.transform(lines, lambda x, k: F.when(keep(x), k))
    return F.filter(at, lambda k: k.isNotNull())


def dedup_lines(docs: DataFrame, edits: int = EDITS, scratch: Scratch | None = None) -> DataFrame:
    """The documents with the lines that stay; all columns as they were but text."""
    i, h, k, ls = fresh(docs, "doc", "hash", "kept", "lines")
    kept = kept_lines(docs, edits, scratch).select(F.col("doc_id").alias(i), F.col("th").alias(h), F.col("kept").alias(k))
    text = F.col("text").cast("string")
    joined = docs.join(kept, (F.col("doc_id").cast("long") == F.col(i)) & (F.xxhash64(text) == F.col(h)), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in docs.columns], k, F.explode(F.array(_split(text))).alias(ls))
    stay = F.array_sort(F.concat(F.coalesce(F.col(k), F.array().cast("array<int>")), _places(F.col(ls), _blank)))
    changed = F.array_join(F.transform(stay, lambda x: F.try_element_at(F.col(ls), x + 1)), "\n")
    changed = F.when(F.col("doc_id").isNull() | F.col("text").isNull(), text).otherwise(changed)
    return joined.select(*[changed.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def removed_lines(docs: DataFrame, edits: int = EDITS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed and removed, the places of the removed lines (array<int>), for every document."""
    none = F.array().cast("array<int>")
    lines = F.col("lines")
    own = _split_once(_rows(docs))
    own = own.select("doc_id", "th", F.greatest(F.coalesce(F.size(lines), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(_places(lines, lambda x: ~_blank(x)), none).alias("some"))
    out = own.join(kept_lines(docs, edits, scratch), ["doc_id", "th"], "left")
    gone = F.when(F.col("doc_id").isNull(), none).otherwise(F.array_except("some", F.coalesce("kept", none)))
    return out.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = removed_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda k: k.cast("string")), ",").alias("removed"))


#: The definition itself: an earlier line that is equal, or one edit away. Half of a line stays as it is under one edit.
OP6_SQL = """
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM split
), firsts AS (
  SELECT line, length(line) AS n, min((doc_id, pos)) AS f FROM lines WHERE regexp_replace(line, '\\s', '', 'g') <> '' GROUP BY line
), long AS (
  SELECT * FROM firsts WHERE n >= 16
), pairs AS (
  SELECT s.line AS s, t.line AS t, s.n AS n, t.n - s.n AS d, s.f AS sf, t.f AS tf
  FROM long s JOIN long t ON t.n = s.n AND s.line <> t.line AND left(s.line, s.n // 2) = left(t.line, s.n // 2)
  UNION ALL SELECT s.line, t.line, s.n, t.n - s.n, s.f, t.f
  FROM long s JOIN long t ON t.n = s.n AND s.line <> t.line AND right(s.line, s.n // 2) = right(t.line, s.n // 2)
  UNION ALL SELECT s.line, t.line, s.n, t.n - s.n, s.f, t.f
  FROM long s JOIN long t ON t.n = s.n + 1 AND left(s.line, s.n // 2) = left(t.line, s.n // 2)
  UNION ALL SELECT s.line, t.line, s.n, t.n - s.n, s.f, t.f
  FROM long s JOIN long t ON t.n = s.n + 1 AND right(s.line, s.n // 2) = right(t.line, s.n // 2)
), near AS (
  SELECT DISTINCT s, t, sf, tf FROM pairs
  WHERE len(list_filter(range(n + 1), lambda i: left(s, i) = left(t, i) AND substr(s, i + 2 - d) = substr(t, i + 2))) > 0
), gone AS (
  SELECT t AS line FROM near WHERE sf < tf UNION SELECT s FROM near WHERE tf < sf
), kept AS (
  SELECT f[1] AS doc_id, f[2] AS pos FROM firsts WHERE line NOT IN (SELECT line FROM gone)
), marked AS (
  SELECT l.doc_id, l.pos, regexp_replace(l.line, '\\s', '', 'g') <> '' AND k.pos IS NULL AS removed
  FROM lines l LEFT JOIN kept k ON k.doc_id = l.doc_id AND k.pos = l.pos
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
  coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (removed), '') AS removed
FROM marked GROUP BY doc_id
"""

"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. The
stages are written as Parquet and read again, so that a lost executor never costs more than one stage.

Defined results: an empty table passes through every stage; rows without a doc_id are judged by their text in
the filters, and are left as they are where rows are told apart by id; rows with one doc_id and one text are one
document, rows with one doc_id and different texts are different ones; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, langid, linededup, nearcopies
from tessera.llm.common import Scratch, fresh, table

#: A document is rejected if it has no letter, or if its language is less sure than this.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    model = langid.train(docs)
    if not model.classes:  # nothing is labelled, so only texts without a letter are rejected
        return docs.filter(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    return langid.keep_known(docs, model, LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document, or line, has."""
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have Jaccard 0.8 or more: the one with the smallest id."""
    scratch = Scratch(spark)
    i, h = fresh(docs, "doc", "hash")
    others = scratch.save(nearcopies.near_copies(docs, scratch).filter("not first").select(F.col("doc_id").alias(i), F.col("th").alias(h)).distinct())
    return docs.join(others, (F.col("doc_id").cast("long") == F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h)), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document that is left."""
    return bpe.encode_texts(docs, bpe.tokenizer_file())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    before = None
    for _, stage in STAGES[:-1]:
        docs, old = scratch.save(stage(spark, docs, sf_dir)), before
        before = docs
        if old is not None:
            scratch.drop(old)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID, SimHash and BPE are not to be had in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None

"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``documents``. ``run`` writes each stage's result as Parquet and reads it again for the next.

Null and empty texts fail the base rules and go in the first stage; texts of any length are read whole. Repeated
rows are judged alike and stay or go together until near duplicates, where all rows of the one document that
stays of a group stay. Null doc_ids are documents of their own there. Empty tables pass through all stages. Without
labels only the base rules reject; without any known language no document is rejected for its language. Columns
besides those of ``documents`` are left out. A stage bounds the Arrow batches of its session in bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import langid, ngram_join, packing, quality, suffix_dedup
from factgraph.llm.common import bounded_batches, drop_table, stage_table
from factgraph.llm.entries import fold, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def in_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a risk-controlled cutoff go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


@in_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents rejected as none of the learned languages go."""
    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    if model is None:  # nothing to tell languages by
        return docs.select(*COLUMNS)
    return langid.identify(docs, model, keep=tuple(COLUMNS)).where("not rejected").select(*COLUMNS)


@in_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles the one of smallest doc_id stays."""
    groups = ngram_join.ngram_groups(docs)
    gone = groups.where("id <> component").select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


@in_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out; a document of which nothing is left goes."""
    cut = suffix_dedup.remove_repeats(docs, keep=("lang", "source"), as_text=True)
    return cut.where("kept <> ''").select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


@in_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("language id", language_id), ("near duplicates", near_duplicates), ("suffix-array dedup", repeated_passages), ("best-fit packing", pack_sequences)]
#: The verdicts of trained stages can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_table(docs)  # a stage's table goes once the next one is written
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

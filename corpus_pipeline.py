"""A training corpus from raw documents: filter, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last keep the columns of documents,
and any further ones, whatever their names.

Defined results: a null or empty text has no words and is rejected by the quality rules, as is any text
of under 50 words; so later stages meet neither in a run of all, but each by itself takes them for
empty texts (equal to each other, in one class, of size 0, of one token). Rows with a null key stay; of
repeated rows one stays after exact dedup. A null source is a source of its own. Texts of any
length go through whole. An empty table stays empty through all stages.
"""

from __future__ import annotations

from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strada.llm import drr_packing, exact_dedup, fertility_quality, mvh_mixing, omh_dedup, queries
from strada.llm.common import scratch, settle, table

#: Places of a worker's table of known words in packing: the executors have come through four stages by then, and memory is what is short.
PLACES = 1 << 20


def settled(stage):
    """The stage, with the executors' heaps shrunk before it and before its result is written."""

    @wraps(stage)
    def run_settled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        settle(spark)
        out = stage(spark, docs, sf_dir)
        settle(spark)
        return out

    return run_settled


@settled
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that its rules reject go."""
    return fertility_quality.keep_good(docs, queries.vocabulary_file("piece_bpe_32k.model"))


@settled
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


@settled
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each class of near copies stays."""
    return omh_dedup.keep_one(docs)


@settled
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents as often as their source's target takes them, in mixed order."""
    return mvh_mixing.mix(docs)


@settled
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of documents in sequences of at most 2048 tokens."""
    return drr_packing.pack(docs, replace(queries.word_bpe(), places=PLACES))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: SQL cannot express tokenisation, near copies or the splitting tree.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

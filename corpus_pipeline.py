"""The corpus pipeline: quality rules, exact dedup, near dedup, substring dedup, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm import exact_dedup, packing, quality, recompression, simhash
from talentlake.llm.common import cut, free_shuffles, held_tables, release_unread
from talentlake.llm.queries import BYTE_BPE


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that a stage's result still reads while it is written.
_left: list[str] = []


def _stage(function: Stage) -> Stage:
    """A stage that first deletes what the stages before have left in the shared folder, as far as ``docs`` does not read it: once
    their rows are written, nobody needs it. A lost executor costs nothing that this would have kept."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            _left[:] = release_unread(spark, _left, docs)
            free_shuffles(spark)
        before = set(held_tables())
        out = function(spark, docs, sf_dir)
        _left.extend(p for p in held_tables() if p not in before)
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


@_stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that fingerprints within 3 bits, as in op3, or a Jaccard similarity of 0.8 over 5-word shingles link the one with
    the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs, similarity=(4, 5), set_shingle=5)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that occur earlier go; n_chars follows the text."""
    return recompression.drop_passages(docs).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs, BYTE_BPE, capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", pack),
]

#: SQL cannot express the near-dedup, sketch and tokenizer stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

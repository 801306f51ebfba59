"""A training corpus from raw documents, stage by stage.

Every stage is one operator of ``gaugeflow.llm`` over all documents that the stage before
it kept; all but the last give rows of ``documents``. Each result is written below
``spark.checkpoint.dir`` and read again, so that a lost executor costs its tasks only and
no stage is computed twice.

Defined cases of all stages: an empty table gives an empty one; columns of any other name
are carried along up to the last stage; rows without doc_id are scored, tested against the
benchmark and packed (as null), but neither lose lines nor go as near copies; null and
empty texts are scored as empty ones, pass all other stages and have no place in a window;
equal rows are one document that goes or stays as one; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.llm import cotrain, fuzzyhash, linedup, packing, winnow
from gaugeflow.llm.shared import remove, settle, workdir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; all, without labels of both kinds.
    Ties with the threshold stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotrain.drop_rejected(docs, cotrain.train(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first copy of every line only, in the order of doc_id; those left
    without a visible line go."""
    return linedup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id."""
    return fuzzyhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage of 13 words with the benchmark; all, if it is empty."""
    return winnow.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of a fixed token count over the documents left."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        at = workdir(spark, f"pipeline-{name.replace(' ', '-')}")
        docs = settle(stage(spark, docs, sf_dir), at)
        if last is not None:
            remove(spark, last)
        last = at
    return STAGES[-1][1](spark, docs, sf_dir)

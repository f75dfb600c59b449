"""A corpus from raw documents: each stage's rows are written as Parquet and read again by the next.

Quality rules drop documents, SimHash and shared shingles find near copies of which one stays, suffix arrays take repeated passages
out of texts, the secret scan puts a mark in place of secrets, and packing
gives the pieces of the training sequences. The first four return the columns of documents, and any others that these have.

Null text fails the quality rules; a stage that is given one itself takes it for an empty text (which
the secret scan returns in its place). Repeated rows are one group of copies. Rows without doc_id are judged like others; they neither take passages out of
other texts nor lose any. Other columns may have any names, those of the stages' own results included. No rows give none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import near_copies, packing, quality, secrets, suffix_family
from cellweave.llm._shared import discard, named, release, stored, work_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: DuckDB SQL can't express fingerprints or tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars after a change of the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffix_family.without_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.redacted(docs))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("secret scans", secret_scan),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        before = named()
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{i}")
        release(spark, before)  # a stage's own tables are of no use once its rows are stored
        if i:
            discard(spark, f"{folder}/{i - 1}")
    return docs

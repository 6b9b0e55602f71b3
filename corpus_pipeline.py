"""A training-data pipeline over ``documents``: each stage reads what the one before kept.

SQL cannot express the stages from line dedup on (content-defined chunks,
Order MinHash, the cube method, piece encoding), so ORACLE_SQL is None; the
tests hold every stage against a brute-force version.

Null texts are empty and fail the quality rules. Repeated rows are one document
from near_dedup on. An empty table gives no rows. Columns beside those of
``documents`` pass through every stage but the last, which returns doc_id,
lang, source, n_tokens, ids and decoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import adaptive_quality, common, cube_mix, line_chunks, order_minhash, piece_codec

PIECES = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return adaptive_quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cube_mix.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(docs, public_tokenizers.path(PIECES), keep=("lang", "source"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries of this subpackage, one an operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive_quality, byte_codec, collocations, cover_dedup, cube_mix, dialogue_repair, extendible, line_chunks, markov_secrets, order_minhash, piece_codec, rp_forest, url_filter
from . import oracles

#: The rules that op1 judges by.
URL_RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]
#: First labels of the junk hosts whose pages make the list of canonical URLs.
JUNK = ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
SHARD_BYTES = 64 << 10
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of op1: the canonical URLs of all pages of the junk hosts, so it grows with the table."""
    host, path = url_filter.split_url(F.col("url"))
    rows = pages.select(host.alias("host"), url_filter.canonical(host, path).alias("url"))
    return rows.where(F.col("host").rlike(rf"^((www|m)\.)?({'|'.join(JUNK)})\.")).select("url").distinct()


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, listed_urls(pages), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_chunks.dedup_lines(docs, counts=True)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = cube_mix.mix(docs).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_quality.score_documents(table(spark, sf_dir, "documents"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.assign_shards(table(spark, sf_dir, "documents"), limit=SHARD_BYTES).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = piece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return done.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov_secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_dedup.repeated_words(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults made by crc32 of ``conv_id:turn``: dropped, emptied, unended, repeated or of another role."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("_d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    key = dialogue_repair.conversation_key("conv_id").alias("_c")
    report, repaired = dialogue_repair.repair(damaged(rows))
    done = rows.select("conv_id").distinct().select("conv_id", key).join(report.select(key, *report.columns[1:]), "_c", "left").join(dialogue_repair.digests(repaired), "_c", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return done.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return collocations.top_phrases(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_url_filter, op2_line_dedup, op3_source_mix, op4_quality_rules, op5_nearest_vectors, op6_sharding,
        op7_sentencepiece, op8_secret_scan, op9_near_dedup, op10_substring_dedup, op11_dialogue_repair, op12_collocations, op13_byte_bpe, pipeline,
    )}


def oracle_sql() -> dict[str, str]:
    return oracles.statements(URL_RULES, JUNK, SHARD_BYTES)

"""Q23: where things come from: sources, relations and answered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_references, reference_quote
from ..operators.listing import capped, chunks_per_document

CAP = 50
ZERO = "00000000-0000-0000-0000-000000000000"


def source_lineage(sources: DataFrame, documents: DataFrame, chunks: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """(source_id, document_id, generation, is_active, n_chunks, n_entities): every document of the sources, D07."""
    rows = documents.join(sources.select("source_id", "name"), "source_id").join(chunks_per_document(chunks), "document_id", "left")
    if mentions is not None:
        met = chunks.select("document_id", "chunk_id").join(mentions, "chunk_id").groupBy("document_id").agg(F.countDistinct("entity_id").alias("n_entities"))
        rows = rows.join(met, "document_id", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))
    return rows.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def relation_lineage(relations: DataFrame, evidence: DataFrame, visible: DataFrame, cap: int = CAP) -> DataFrame:
    """the strongest visible evidence of each relation, with its chunk's place."""
    rows = evidence.join(relations.select("relation_id", "predicate"), "relation_id").join(visible.select("chunk_id", "source_id", "document_id", "ordinal", "text"), "chunk_id")
    rows = rows.withColumn("quote", reference_quote(F.col("quote") if "quote" in evidence.columns else F.col("text"))).drop("text")
    return capped(rows, ["relation_id"], [F.desc("confidence"), "chunk_id"], cap)


def query_lineage(queries: DataFrame, visible: DataFrame) -> DataFrame:
    """The references of answered queries, each with its chunk where it is still visible; else available is false and ids are kept, or zero."""
    refs = queries.select("query_id", F.posexplode(parse_references(F.col("references"))).alias("position", "r")).select("query_id", "position", "r.*")
    there = visible.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("source_name"), "text", F.lit(True).alias("available"))
    rows = refs.join(there, "chunk_id", "left")
    keep = lambda c: F.coalesce(c, F.lit(ZERO)).alias(c)
    return rows.select("query_id", "position", keep("source_id"), keep("document_id"), keep("chunk_id"), "chunk_ordinal", "score", "source_name", reference_quote(F.col("text")).alias("quote"), F.coalesce("available", F.lit(False)).alias("available"))

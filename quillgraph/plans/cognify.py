"""Q08-Q10, Q21: from pending sources to chunks, entities, relations, summaries and projection commands.

Everything is set-oriented: the extraction of all chunks is exploded once,
local ids are resolved by joins inside their chunk, and new rows are merged
with existing ones by their canonical keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..functions.chunker import chunk_documents
from ..functions.scalars import DOCUMENT_SUMMARY_VERSION, canonical_entity_key, document_summary_id, first_mention, relation_predicate, uuid5, valid_extraction
from ..operators import projection
from ..operators.scope import cognify_candidates, not_yet
from ..session import scratch

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def selected(sources: DataFrame, documents: DataFrame, chunks: DataFrame, summaries: DataFrame, *, force: bool = False) -> DataFrame:
    """Sources with ``plan``: skip (complete), resume (some chunks, no complete summary), reset (a reset document) or full."""
    todo = cognify_candidates(sources, force=force)
    cols = ["source_id", "document_id", "generation", *(["reset"] if "reset" in documents.columns else [])]
    docs = documents.where("is_active").select(*cols)
    has_chunks = chunks.where("is_active").select("document_id", F.lit(True).alias("_chunks")).distinct()
    done = summaries.where(f"is_active and prompt_version = '{DOCUMENT_SUMMARY_VERSION}'").select("document_id", F.lit(True).alias("_summary")).distinct() if "prompt_version" in summaries.columns else summaries.where("is_active").select("document_id", F.lit(True).alias("_summary")).distinct()
    rows = todo.join(docs, "source_id", "left").join(has_chunks, "document_id", "left").join(done, "document_id", "left")
    reset = F.coalesce(F.col("reset"), F.lit(False)) if "reset" in cols else F.lit(False)
    plan = F.when(reset, "reset").when(F.col("_chunks") & F.col("_summary"), "skip").when(F.col("_chunks"), "resume").otherwise("full")
    return rows.select(*sources.columns, "document_id", plan.alias("plan"))


def prepared(documents: DataFrame, *, most: int = 800, overlap: int = 120, least: int = 80, embed=providers.HashEmbedding, extract=providers.CapitalizedExtraction) -> DataFrame:
    """Q09: chunks of ``documents(document_id, source_id, dataset_id, generation, normalized_text)`` with embedding, extraction and whether it is valid. Materialised: models are called once."""
    chunks = chunk_documents(documents, most=most, overlap=overlap, least=least)
    rows = chunks.withColumn("embedding", providers.embed(F.col("text"), embed)).withColumn("extraction", providers.extract(F.col("text"), extract))
    rows = rows.withColumn("valid", valid_extraction(F.col("extraction"), F.col("text")))
    scratch(rows.sparkSession)
    return rows.checkpoint()


def extracted_entities(rows: DataFrame) -> DataFrame:
    """Entities of valid extractions with their canonical key and id, one row a chunk and local id."""
    e = rows.where("valid").select("dataset_id", "generation", "document_id", "ordinal", "chunk_id", "text", F.posexplode("extraction.entities").alias("at", "e"))
    e = e.select("dataset_id", "generation", "chunk_id", "text", F.struct("document_id", "ordinal", "at").alias("seen"), "e.*")
    e = e.withColumn("canonical_key", canonical_entity_key(F.col("type"), F.col("name")))
    return e.withColumn("entity_id", uuid5(NAMESPACE, F.concat_ws(":", F.lit("entity"), F.col("dataset_id").cast("string"), "canonical_key")))


def merged_entities(found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row a canonical key: first name, type and description that is not empty, all aliases in order of appearance, highest confidence.

    Existing rows count as seen first.
    """
    cols = ["dataset_id", "canonical_key", "entity_id", "generation", "name", "type", "description", "aliases", "confidence"]
    rows = found.select(F.lit(1).alias("turn"), "seen", *cols)
    if existing is not None:
        rows = existing.select(F.lit(0).alias("turn"), F.lit(None).cast(found.schema["seen"].dataType).alias("seen"), *cols).unionByName(rows)
    # One pass: a row a key and alias first, then a row a key; values go with the place at which they are first seen.
    order = F.struct("turn", "seen")
    key = ["dataset_id", "canonical_key"]
    rows = rows.select(*key, "generation", "confidence", F.struct(order.alias("o"), "entity_id", "name", "type").alias("first"), F.when(F.length(F.trim("description")) > 0, F.struct(order.alias("o"), "description")).alias("said"), order.alias("o"), F.posexplode_outer("aliases").alias("p", "alias"))
    best = [F.max("generation").alias("generation"), F.max("confidence").alias("confidence"), F.min("first").alias("first"), F.min("said").alias("said")]
    rows = rows.groupBy(*key, "alias").agg(*best, F.min(F.when(F.col("p").isNotNull(), F.struct("o", "p"))).alias("f"))
    rows = rows.groupBy(*key).agg(*best, F.transform(F.array_sort(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "alias")))), lambda x: x["alias"]).alias("aliases"))
    return rows.select(*key, "first.entity_id", "generation", "first.name", F.col("first.type").alias("entity_type"), F.coalesce("said.description", F.lit("")).alias("description"), "confidence", "aliases")


def mention_rows(found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One mention an entity and chunk, with the place of its first name or alias."""
    m = found.withColumn("m", first_mention(F.col("text"), F.col("name"), F.col("aliases")))
    m = m.groupBy("entity_id", "chunk_id").agg(F.min_by(F.struct("m.surface_text", "m.start_char", "m.end_char", "confidence"), "seen").alias("m")).select("entity_id", "chunk_id", "m.*")
    m = m.withColumn("mention_id", uuid5(NAMESPACE, F.concat_ws(":", F.lit("mention"), "entity_id", "chunk_id")))
    return m if existing is None else not_yet(m, existing, ["entity_id", "chunk_id"])


def extracted_relations(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Relations with the ids of their ends, resolved inside the chunk."""
    r = rows.where("valid").select("dataset_id", "generation", "document_id", "ordinal", "chunk_id", F.posexplode("extraction.relations").alias("at", "r"))
    r = r.select("dataset_id", "generation", "chunk_id", F.struct("document_id", "ordinal", "at").alias("seen"), "r.*").withColumn("predicate", relation_predicate(F.col("predicate")))
    ids = found.select("chunk_id", "local_id", "entity_id")
    for end in ("source", "target"):
        r = r.join(ids.select("chunk_id", F.col("local_id").alias(f"{end}_local_id"), F.col("entity_id").alias(f"{end}_entity_id")), ["chunk_id", f"{end}_local_id"])
    return r.withColumn("relation_id", uuid5(NAMESPACE, F.concat_ws(":", F.lit("relation"), F.col("dataset_id").cast("string"), "source_entity_id", "predicate", "target_entity_id")))


def merged_relations(found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row an identity: highest confidence, the first description that is not empty."""
    cols = ["relation_id", "dataset_id", "generation", "source_entity_id", "target_entity_id", "predicate", "description", "confidence"]
    rows = found.select(F.lit(1).alias("turn"), "seen", *cols)
    if existing is not None:
        rows = existing.select(F.lit(0).alias("turn"), F.lit(None).cast(found.schema["seen"].dataType).alias("seen"), *cols).unionByName(rows)
    said = F.length(F.trim("description")) > 0
    return rows.groupBy("relation_id", "dataset_id", "source_entity_id", "target_entity_id", "predicate").agg(
        F.max("generation").alias("generation"), F.coalesce(F.min_by(F.when(said, F.col("description")), F.when(said, F.struct("turn", "seen"))), F.lit("")).alias("description"), F.max("confidence").alias("confidence"))


def evidence_rows(found: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One quote a relation and chunk."""
    e = found.groupBy("relation_id", "chunk_id").agg(F.min_by("evidence", "seen").alias("quote"), F.max("confidence").alias("confidence"))
    return e if existing is None else not_yet(e, existing, ["relation_id", "chunk_id"])


def summary_rows(rows: DataFrame, make=providers.LeadSummary, embed=providers.HashEmbedding) -> DataFrame:
    """One summary a document, of its chunks' summaries in order."""
    per = rows.groupBy("dataset_id", "source_id", "document_id", "generation").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("extraction.summary", F.substring("text", 1, 200)).alias("s")))), lambda x: x["s"]).alias("parts"))
    out = per.withColumn("text", providers.summarize(F.col("parts"), make)).drop("parts")
    out = out.withColumn("embedding", providers.embed(F.col("text"), embed)).withColumn("prompt_version", F.lit(DOCUMENT_SUMMARY_VERSION)).withColumn("is_active", F.lit(True))
    return out.withColumn("summary_id", document_summary_id(F.col("document_id").cast("string"), F.col("generation")))


def commands(parts: dict[str, DataFrame]) -> DataFrame:
    """Upsert commands of everything persisted, one an identity."""
    d = F.col("dataset_id")
    ent = parts["entities"].select(*projection.command("entity", "upsert", F.col("entity_id"), d, payload=F.struct("name", "entity_type", "description")))
    chk = parts["chunks"].select(*projection.command("chunk", "upsert", F.col("chunk_id"), d, payload=F.struct("ordinal", "document_id")))
    men = parts["mentions"].join(parts["chunks"].select("chunk_id", "dataset_id"), "chunk_id").select(*projection.command("entity_mention", "upsert", F.col("mention_id"), d, F.col("entity_id"), F.col("chunk_id"), F.struct("confidence")))
    rel = parts["relations"].select(*projection.command("relation", "upsert", F.col("relation_id"), d, F.col("source_entity_id"), F.col("target_entity_id"), F.struct("predicate", "confidence")))
    nxt = projection.next_edges(parts["chunks"]).select(*projection.command("chunk_next", "upsert", F.concat_ws(">", "chunk_id", "next_chunk_id"), d, F.col("chunk_id"), F.col("next_chunk_id")))
    return ent.unionByName(chk).unionByName(men).unionByName(rel).unionByName(nxt)


def cognified(documents: DataFrame, existing: dict[str, DataFrame] | None = None, **options) -> dict[str, DataFrame]:
    """Q10: all rows that the documents give, merged with ``existing`` entities, relations, mentions and evidence."""
    have = existing or {}
    rows = prepared(documents, **options)
    found = extracted_entities(rows)
    links = extracted_relations(rows, found)
    out = {
        "chunks": rows.drop("extraction"), "entities": merged_entities(found, have.get("entities")), "mentions": mention_rows(found, have.get("mentions")),
        "relations": merged_relations(links, have.get("relations")), "evidence": evidence_rows(links, have.get("evidence")), "summaries": summary_rows(rows),
    }
    out["commands"] = commands(out)
    out["rejected"] = rows.where("not valid").select("chunk_id", "document_id")
    return out

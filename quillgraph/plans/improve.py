"""Batch upkeep of weights, vectors, duplicates, summaries and projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..functions.rounding import clamp_weight, effective_importance, round4
from ..functions.scalars import DOCUMENT_SUMMARY_VERSION, dataset_summary_id, entity_text, relation_text
from ..operators import dedup, graph, scope

STAGES = ("feedback", "deduplication", "relation_embeddings", "summaries", "reconciliation", "maintenance")
DEFAULT_STAGES = ("feedback", "deduplication", "relation_embeddings")


def checked_stages(stages: list[str] | None) -> list[str]:
    """Q12: stages in the engine's order. Rewired relations lose their vector, so embedding follows deduplication; reconciliation comes before maintenance, whose upserts would hide missing nodes."""
    asked = list(DEFAULT_STAGES) if stages is None else stages
    unknown = set(asked) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")
    return [s for s in STAGES if s in asked]


def with_entity_vectors(entities: DataFrame, make=providers.HashEmbedding) -> DataFrame:
    """Q14: vectors for entities without one; the others stay as they are."""
    made = F.when(F.col("embedding").isNull(), providers.embed(F.when(F.col("embedding").isNull(), entity_text(F.col("name"))), make))
    return entities.withColumn("embedding", F.coalesce("embedding", made))


def with_relation_vectors(relations: DataFrame, entities: DataFrame, make=providers.HashEmbedding) -> DataFrame:
    """Q14: vectors for relations without one."""
    n = entities.select("entity_id", "name")
    rows = relations.join(n.select(F.col("entity_id").alias("source_entity_id"), F.col("name").alias("_a")), "source_entity_id", "left").join(n.select(F.col("entity_id").alias("target_entity_id"), F.col("name").alias("_b")), "target_entity_id", "left")
    text = F.when(F.col("embedding").isNull() & F.col("_a").isNotNull() & F.col("_b").isNotNull(), relation_text(F.col("_a"), F.col("predicate"), F.col("description"), F.col("_b")))
    return rows.withColumn("embedding", F.coalesce("embedding", providers.embed(text, make))).select(*relations.columns)


def deduplicated(entities: DataFrame, mentions: DataFrame, relations: DataFrame, evidence: DataFrame, *, candidate: float = dedup.CANDIDATE, merge: float = dedup.MERGE) -> dict[str, DataFrame]:
    """Candidates, plan, and the tables after the merges."""
    found = graph.kept(dedup.duplicate_candidates(entities, candidate))
    plan = graph.kept(dedup.merge_plan(entities, found.where(F.col("similarity") >= merge)))
    ent, men = dedup.apply_merges(entities, mentions, plan)
    moved = graph.kept(dedup.rewired(relations.where("is_active"), plan))
    copied = dedup.copied_evidence(evidence, moved)
    live = moved.withColumn("is_active", ~F.col("outcome").isin("merged", "self_loop"))
    if "embedding" in relations.columns:
        live = live.withColumn("embedding", F.when(F.col("changed") | ~F.col("is_active"), F.lit(None).cast(relations.schema["embedding"].dataType)).otherwise(F.col("embedding")))
    rel = live.select(*relations.columns).unionByName(relations.where("not is_active"))
    return {"candidates": found, "plan": plan, "entities": ent, "mentions": men, "relations": rel, "evidence": evidence.unionByName(copied), "outcomes": moved.groupBy("outcome").count()}


def importance(rows: DataFrame, centrality: DataFrame, id_col: str) -> DataFrame:
    """Rows whose weight or marker changes: feedback_weight, centrality_weight and importance_weight.

    ``rows``: id, importance_weight, feedback_weight and centrality_weight of a
    valid marker (null: none). A rerun on the result changes nothing.
    """
    got = rows.join(centrality.select(id_col, F.col("centrality").alias("_c")), id_col, "left")
    fb = F.when(F.col("feedback_weight").isNotNull(), clamp_weight(F.col("feedback_weight").cast("double"))).otherwise(clamp_weight(F.col("importance_weight").cast("double")))
    got = got.withColumns({"_f": fb, "_c": F.coalesce("_c", F.lit(0.0))})
    got = got.withColumn("_w", effective_importance(F.col("_f"), F.col("_c")))
    same = F.col("feedback_weight").cast("double").eqNullSafe(F.col("_f")) & F.col("centrality_weight").cast("double").eqNullSafe(F.col("_c")) & (round4(F.col("importance_weight").cast("double")) == F.col("_w"))
    keep = [c for c in rows.columns if c not in ("importance_weight", "feedback_weight", "centrality_weight")]
    return got.where(~same).select(*keep, F.col("_f").alias("feedback_weight"), F.col("_c").alias("centrality_weight"), F.col("_w").alias("importance_weight"))


def maintained(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """Relations to deactivate, and changed weights of entities and of the relations left. ``evidence``: visible evidence."""
    gone = graph.without_evidence(relations, evidence)
    rest = relations.join(gone.select("relation_id"), "relation_id", "left_anti")
    c = graph.kept(graph.degree_centrality(rest, entities.select("entity_id")))
    return {"deactivated": gone.select("relation_id"), "entities": importance(entities, c, "entity_id"), "relations": importance(rest, graph.relation_centrality(rest, c), "relation_id")}


def rebuilt_summaries(documents: DataFrame, chunks: DataFrame, summaries: DataFrame, make=providers.LeadSummary) -> dict[str, DataFrame]:
    """New summaries of documents without a complete one; the summary of their dataset where one changed or none exists; other active ones to deactivate.

    ``documents``: current ones (scope.summary_inputs). ``summaries``:
    target_type, target_id, prompt_version, text, is_active.
    """
    whole = summaries.where(f"is_active and target_type = 'document' and prompt_version = '{DOCUMENT_SUMMARY_VERSION}' and length(text) > 0").select(F.col("target_id").alias("document_id")).distinct()
    todo = documents.join(whole, documents["document_id"].cast("string") == whole["document_id"].cast("string"), "left_anti")
    parts = chunks.where("is_active").join(todo.select("document_id", F.col("generation").alias("_g")), "document_id").where("generation = _g")
    parts = parts.groupBy("dataset_id", "document_id", "generation").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]).alias("t"))
    fresh = graph.kept(parts.select("dataset_id", "document_id", "generation", providers.summarize(F.col("t"), make).alias("text")))
    old = summaries.where("is_active and target_type = 'document'").select(F.col("target_id").cast("string").alias("document_id"), "text")
    texts = documents.select("dataset_id", F.col("document_id").cast("string").alias("document_id"), "generation")
    now = texts.join(fresh.select(F.col("document_id").cast("string").alias("document_id"), F.col("text").alias("new")), "document_id", "left").join(old, "document_id", "left").withColumn("text", F.coalesce("new", "text"))
    have = summaries.where("is_active and target_type = 'dataset'").select(F.col("target_id").cast("string").alias("_d")).distinct()
    changed = now.groupBy("dataset_id").agg(F.count_if(F.col("new").isNotNull()).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("document_id", "text"))), lambda x: x["text"]).alias("t"), F.max("generation").alias("generation"))
    changed = changed.join(have, F.col("dataset_id").cast("string") == F.col("_d"), "left").where("n > 0 or _d is null")
    sets = changed.select("dataset_id", "generation", providers.summarize(F.col("t"), make).alias("text"), dataset_summary_id(F.col("dataset_id").cast("string"), F.col("generation")).alias("summary_id"))
    gone = summaries.where("is_active and target_type = 'document'").join(texts.select(F.col("document_id").alias("target_id")), "target_id", "left_anti")
    return {"documents": fresh, "datasets": sets, "deactivated": gone}

"""Q01-Q05: recall as one lazy plan over a table store.

``t`` is a mapping of table names to DataFrames with the engine's columns:
datasets, sources, documents, chunks (with embedding), summaries, entities,
mentions, relations, evidence.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexical import parse_query
from ..functions.scalars import write_references
from ..operators import graph, scope, search
from ..operators.lexical_index import LexicalIndex

SEEDS, MOST_RECORDS = 10, 100
MODES = ("chunks", "rag", "graph", "triplets", "hybrid", "summaries")


def chunk_hits(visible: DataFrame, vector: list[float], text: str, *, top_k: int | None = None, candidates: int = search.CANDIDATES, rrf_k: int = search.RRF_K, index: LexicalIndex | None = None) -> DataFrame:
    """Q01: fused hits with their chunk columns. Text joins the few ids that stay; with an ``index`` of the chunks no other text is read."""
    k = search.checked_top_k(top_k)
    near = search.ranked(search.vector_top_k(visible, vector, candidates), F.desc("score"), "chunk_id")
    found = index.top_k(parse_query(text), candidates, within=graph.kept(visible.select("chunk_id"))) if index else search.lexical_top_k(visible, parse_query(text), candidates)
    said = search.ranked(found, F.desc("rank_score"), "chunk_id")
    fused = search.fuse(near, said, k=rrf_k, top_k=k)
    return visible.drop("embedding", "lexical").join(fused, "chunk_id")


def summary_hits(visible: DataFrame, vector: list[float], *, top_k: int | None = None) -> DataFrame:
    """Q02: document summaries by similarity."""
    best = search.vector_top_k(visible, vector, search.checked_top_k(top_k), "summary_id")
    return visible.drop("embedding").join(best, "summary_id").orderBy(F.desc("score"), "summary_id")


def graph_hits(hits: DataFrame, visible: DataFrame, mentions: DataFrame, relations: DataFrame, entities: DataFrame, evidence: DataFrame, *, top_k: int, seeds: int = SEEDS) -> dict[str, DataFrame]:
    """Q03, C14: entities, relations and evidence around the best hits. Authority is checked on the authoritative rows."""
    order = (F.desc("score"), F.col("chunk_id").cast("string"))
    seed = hits.select("chunk_id", "score", F.row_number().over(Window.orderBy(*order)).alias("rank")).where(F.col("rank") <= seeds)
    records = graph.one_hop(seed, mentions, relations, MOST_RECORDS)
    entity_scores, relation_scores = graph.graph_scores(records, seed)
    rel = relations.join(relation_scores, "relation_id").orderBy(F.desc("score"), F.col("relation_id").cast("string")).limit(top_k)
    proof = scope.hydrated_evidence(evidence, visible, rel)
    first = proof.select("relation_id", "chunk_id", *(["quote"] if "quote" in evidence.columns else [F.col("text").alias("quote")]), "confidence")
    best = first.groupBy("relation_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "chunk_id", "quote")).alias("b"))  # E06
    rel = rel.join(best, "relation_id", "left").withColumn("evidence", F.col("b.quote")).withColumn("evidence_chunk_id", F.col("b.chunk_id")).drop("b")
    from_relations = graph.scores_from_relations(rel).withColumnRenamed("score", "relation_score")
    ent = graph.candidate_entities(entity_scores, rel).join(entity_scores, "entity_id", "left").join(from_relations, "entity_id", "left")
    ent = entities.join(ent.select("entity_id", F.coalesce("score", "relation_score", F.lit(0.0)).alias("score")), "entity_id")
    return {"entities": graph.by_score(ent, "entity_id"), "relations": graph.by_score(rel, "relation_id"), "evidence": proof}


def recall(t: Mapping[str, DataFrame], vector: list[float], text: str, *, mode: str = "rag", dataset_ids: Sequence | None = None, top_k: int | None = None, only_context: bool = False, **filters) -> dict[str, DataFrame]:
    """The parts of a recall answer: hits or summaries, graph parts, references and context, as far as the mode has them."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    k = search.checked_top_k(top_k)
    if mode == "summaries":
        visible = scope.authoritative_summaries(t["summaries"], t["documents"], t["sources"], t["datasets"], dataset_ids=dataset_ids)
        return {"summaries": summary_hits(visible, vector, top_k=k)}
    visible = scope.authoritative_chunks(t["chunks"], t["documents"], t["sources"], t["datasets"], dataset_ids=dataset_ids, **filters)
    hits = chunk_hits(visible, vector, text, top_k=k)
    out = {"hits": hits}
    if mode in ("graph", "triplets", "hybrid"):
        out |= graph_hits(hits, visible, t["mentions"], t["relations"], t["entities"], t["evidence"], top_k=k)
        proof = out["evidence"] if "quote" in out["evidence"].columns else out["evidence"].withColumn("quote", F.col("text"))
        out["references"] = search.references(hits, proof, out["relations"].select("relation_id", F.col("score").alias("relation_score")))
    else:
        out["references"] = search.references(hits)
    if mode in ("chunks", "rag"):
        out["context"] = search.rag_context(hits)
    elif mode in ("graph", "triplets"):
        out["context"] = search.graph_context(out["entities"], out["relations"])
    else:
        summaries = t["summaries"].join(hits.select("document_id").distinct(), "document_id", "left_semi").where("is_active")
        out["context"] = search.hybrid_context(hits, summaries, out["entities"], out["relations"])
    return out


def audit_row(references: DataFrame, query_id: str, text: str | None, mode: str, dataset_ids: list, as_of) -> DataFrame:
    """Q05: the row kept of a query: its references as JSON, the text only if given."""
    items = references.select(F.struct(F.col("source_id").cast("string").alias("source_id"), F.col("document_id").cast("string").alias("document_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("ordinal").alias("chunk_ordinal"), "score").alias("i"))
    one = items.agg(F.sort_array(F.collect_list(F.struct((-F.col("i.score")).alias("o"), F.col("i.chunk_id").alias("c"), "i"))).alias("x"))
    return one.select(F.lit(query_id).alias("query_id"), F.array(*map(F.lit, dataset_ids)).alias("dataset_ids"), F.lit(text).cast("string").alias("query_text"), F.lit(mode).alias("mode"), write_references(F.transform("x", lambda v: v["i"])).alias("references"), F.lit(as_of).alias("created_at"))

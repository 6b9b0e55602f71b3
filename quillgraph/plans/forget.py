"""Q15-Q21: forgetting sources, datasets and everything, as pure functions from tables to tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import projection, scope
from ..operators.graph import kept

CONFIRM = "DELETE EVERYTHING"


def forget_scope(*, everything: bool = False, source_id=None, dataset=None, memory_only: bool = False, confirm: str | None = None) -> str:
    """Q18: everything, source or dataset, from what was set; raises where the request is not clear."""
    if everything:
        if source_id is not None or dataset is not None or memory_only:
            raise ValueError("everything stands alone")
        if confirm != CONFIRM:
            raise ValueError(f"everything needs confirm={CONFIRM!r}")
        return "everything"
    if confirm is not None:
        raise ValueError("confirm belongs to everything")
    if source_id is not None:
        return "source"
    if dataset is None:
        raise ValueError("name the dataset to forget")
    return "dataset"


def _off(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``is_active`` false for the keyed rows."""
    k = keys.select(on).distinct().withColumn("_off", F.lit(True))
    return df.join(k, on, "left").withColumn("is_active", F.col("is_active") & F.col("_off").isNull()).select(*df.columns)


def forget_sources(t: dict[str, DataFrame], source_ids: DataFrame) -> dict[str, DataFrame]:
    """Q15: ids that become inactive, by table: documents, chunks, relations, entities, and summaries where given.

    In order: the sources' current documents and chunks; relations that keep no
    evidence in what is still visible; entities among those mentioned in the
    chunks that keep neither a visible mention nor an active relation.
    """
    gen = scope.current_datasets(t["datasets"])
    hit = source_ids.select("source_id").distinct()
    now = lambda df: df.where("is_active").join(gen, "dataset_id").where("generation = active_generation").drop("active_generation")
    docs = kept(now(t["documents"]).join(hit, "source_id", "left_semi").select("document_id", "dataset_id"))
    # Ids only, and each used several times below: kept, so that no step reads the tables again.
    chunks = kept(now(t["chunks"]).join(hit, "source_id", "left_semi").select("chunk_id"))
    left = {"documents": _off(t["documents"], docs, "document_id"), "chunks": _off(t["chunks"], chunks, "chunk_id")}
    visible = kept(scope.authoritative_chunks(left["chunks"], left["documents"], t["sources"].join(hit, "source_id", "left_anti"), t["datasets"]).select("chunk_id"))
    touched = t["evidence"].join(chunks, "chunk_id", "left_semi").select("relation_id").distinct()
    live = t["relations"].where("is_active")
    proved = t["evidence"].join(visible.select("chunk_id"), "chunk_id", "left_semi").select("relation_id").distinct()
    relations = kept(live.join(touched, "relation_id", "left_semi").join(proved, "relation_id", "left_anti").select("relation_id"))
    rest = live.join(relations, "relation_id", "left_anti")
    met = t["mentions"].join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("entity_id").distinct()
    mentioned = t["mentions"].join(visible.select("chunk_id"), "chunk_id", "left_semi").select("entity_id").distinct()
    ends = rest.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).distinct()
    entities = met.join(mentioned, "entity_id", "left_anti").join(ends, "entity_id", "left_anti")
    if "entities" in t:
        entities = t["entities"].where("is_active").join(entities, "entity_id", "left_semi").select("entity_id")
    out = {"documents": docs.select("document_id"), "chunks": chunks, "relations": relations, "entities": entities}
    if "summaries" in t:
        s = t["summaries"]
        out["summaries"] = (scope.forget_summaries(s, out["documents"], entities, docs.select("dataset_id")) if "target_type" in s.columns else s.where("is_active").join(out["documents"], "document_id", "left_semi")).select("summary_id")
    return out


def forget_datasets(t: dict[str, DataFrame], dataset_ids: DataFrame, *, memory_only: bool = False) -> dict[str, DataFrame]:
    """Q16: the datasets' active rows, without condition; with ``memory_only`` also the reset documents to cognify again."""
    hit = dataset_ids.select("dataset_id").distinct()
    out = {}
    for name, key in (("documents", "document_id"), ("chunks", "chunk_id"), ("entities", "entity_id"), ("relations", "relation_id"), ("summaries", "summary_id")):
        if name in t:
            out[name] = t[name].where("is_active").join(hit, "dataset_id", "left_semi").select(key)
    if memory_only:
        from ..operators.listing import last_document

        docs = t["documents"].where("is_active").join(hit, "dataset_id", "left_semi")
        out["reset"] = last_document(docs).withColumn("reset", F.lit(True))
    return out


def forget_everything(t: dict[str, DataFrame], conflicts: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Q17: rows of all active and deleting datasets up to the first with a conflict, in id order; and what became of each dataset."""
    from pyspark.sql.window import Window

    all_ = t["datasets"].where("status in ('active', 'deleting')").select("dataset_id")
    rows = all_.join(conflicts.select("dataset_id").distinct().withColumn("_c", F.lit(1)), "dataset_id", "left")
    # Datasets are few (a catalogue), so their running count may stand in one partition.
    rows = rows.withColumn("_before", F.sum(F.coalesce("_c", F.lit(0))).over(Window.orderBy("dataset_id").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select("dataset_id", F.when(F.col("_before") == 0, "forgotten").when((F.col("_before") == 1) & F.col("_c").isNotNull(), "conflict").otherwise("not_reached").alias("outcome"))
    return forget_datasets(t, rows.where("outcome = 'forgotten'")), rows


def concurrency_outcome(request_hash: Column, prior_status: Column, prior_hash: Column, target_status: Column) -> Column:
    """Q19: what a forget request meets: mutated (none before), resumed (an unfinished equal one), reentrant (a finished equal one on a target that is gone), blocked (another one runs)."""
    same = prior_hash == request_hash
    return (
        F.when(prior_status.isNull(), "mutated").when(prior_status.isin("running", "cancelling") & ~same, "blocked").when(prior_status.isin("running", "cancelling", "failed") & same, "resumed")
        .when((prior_status == "succeeded") & same & (target_status == "deleted"), "reentrant").otherwise("mutated")
    )


def finalised_sources(sources: DataFrame, source_ids: DataFrame, *, memory_only: bool) -> DataFrame:
    """Q20: forgotten sources end as deleted, or as pending if only their memory went."""
    k = source_ids.select("source_id").distinct().withColumn("_f", F.lit(True))
    end = "pending" if memory_only else "deleted"
    return sources.join(k, "source_id", "left").withColumn("status", F.when(F.col("_f"), end).otherwise(F.col("status"))).select(*sources.columns)


def finalised_datasets(datasets: DataFrame, dataset_ids: DataFrame) -> DataFrame:
    """Q20: deleting datasets become active again once they are empty."""
    k = dataset_ids.select("dataset_id").distinct().withColumn("_f", F.lit(True))
    return datasets.join(k, "dataset_id", "left").withColumn("status", F.when(F.col("_f") & (F.col("status") == "deleting"), "active").otherwise(F.col("status"))).select(*datasets.columns)


def forget_commands(gone: dict[str, DataFrame], t: dict[str, DataFrame]) -> DataFrame:
    """Delete commands, edges before nodes, the first for each identity."""
    chunk_set = gone["chunks"]
    parts = [
        projection.next_edges(t["chunks"].where("is_active")).join(chunk_set, "chunk_id", "left_semi").select(*projection.command("chunk_next", "delete", F.concat_ws(">", "chunk_id", "next_chunk_id"), F.col("dataset_id"), F.col("chunk_id"), F.col("next_chunk_id"))),
        t["mentions"].join(t["chunks"].select("chunk_id", "dataset_id").join(chunk_set, "chunk_id", "left_semi"), "chunk_id").select(*projection.command("entity_mention", "delete", F.concat_ws("@", "entity_id", "chunk_id"), F.col("dataset_id"), F.col("entity_id"), F.col("chunk_id"))),
        t["chunks"].join(chunk_set, "chunk_id", "left_semi").select(*projection.command("chunk", "delete", F.col("chunk_id"), F.col("dataset_id"))),
    ]
    if "dataset_id" in t["relations"].columns:
        parts.append(t["relations"].join(gone["relations"], "relation_id", "left_semi").select(*projection.command("relation", "delete", F.col("relation_id"), F.col("dataset_id"), F.col("source_entity_id"), F.col("target_entity_id"))))
    if "entities" in t and "dataset_id" in t["entities"].columns:
        parts.append(t["entities"].join(gone["entities"], "entity_id", "left_semi").select(*projection.command("entity", "delete", F.col("entity_id"), F.col("dataset_id"))))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["dataset_id", "aggregate_type", "aggregate_id"])

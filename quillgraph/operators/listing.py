"""Counts, distinct values, latest-of-group choices and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group. Null keys form a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_sources(sources: DataFrame) -> DataFrame:
    """The latest version for each dataset and content."""
    return first_of(sources, ["dataset_id", "content_sha256"], F.desc("version"), F.desc("created_at"), "source_id")


def latest_documents(documents: DataFrame) -> DataFrame:
    """The latest active document for each source and generation."""
    return first_of(documents.where("is_active"), ["source_id", "generation"], *([F.desc("created_at")] if "created_at" in documents.columns else []), "document_id")


def latest_summaries(summaries: DataFrame) -> DataFrame:
    """The latest active summary for each target."""
    return first_of(summaries.where("is_active"), ["target_type", "target_id"], F.desc("created_at"), "summary_id")


def oldest_per_scope(runs: DataFrame) -> DataFrame:
    """The oldest run of each dataset; runs without a dataset share one scope."""
    return first_of(runs, ["dataset_id"], "created_at", "run_id")


def latest_forget(runs: DataFrame, by: str, *, not_run=None, not_code: str | None = None) -> DataFrame:
    """The latest forget run for each source or dataset, leaving out one run and runs that ended in the given code."""
    rows = runs.where("pipeline_type = 'forget'").where(F.col(by).isNotNull())
    if not_run is not None:
        rows = rows.where(F.col("run_id") != F.lit(not_run))
    if not_code is not None:
        rows = rows.where(~F.col("error_code").eqNullSafe(F.lit(not_code)))
    return first_of(rows, [by], F.desc("created_at"), F.desc("run_id"))


def oldest_running(runs: DataFrame) -> DataFrame:
    return runs.where("status in ('running', 'cancelling')").orderBy("created_at", "run_id").limit(1)


def next_version(new: DataFrame, sources: DataFrame) -> DataFrame:
    """Versions of forced re-ingests: after the highest there is, in order of arrival."""
    top = sources.groupBy("dataset_id", "content_sha256").agg(F.max("version").alias("_top"))
    n = F.row_number().over(Window.partitionBy("dataset_id", "content_sha256").orderBy("created_at", "source_id"))
    return new.withColumn("_n", n).join(top, ["dataset_id", "content_sha256"], "left").withColumn("version", (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("int")).drop("_n", "_top")


def last_document(documents: DataFrame) -> DataFrame:
    """The last document of each source, the model of a reset one."""
    return first_of(documents, ["source_id"], *([F.desc("created_at")] if "created_at" in documents.columns else []), F.desc("document_id"))


def dataset_stats(datasets: DataFrame, sources: DataFrame, documents: DataFrame, chunks: DataFrame, entities: DataFrame | None = None, relations: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """The counts of every dataset, one pass a table. Totals ignore generation and activity; chunks_active asks for the whole scope but not for the dataset's status."""
    gen = datasets.select("dataset_id", "active_generation")

    def per(df: DataFrame, **counts: Column) -> DataFrame:
        return df.join(gen, "dataset_id").groupBy("dataset_id").agg(*(F.count_if(c).alias(n) for n, c in counts.items()))

    now = F.col("generation") == F.col("active_generation")
    every = F.lit(True)
    live_docs = documents.where("is_active").select("document_id", F.col("dataset_id").alias("doc_dataset"), F.col("generation").alias("doc_generation"))
    live_src = sources.where("status = 'active'").select("source_id", F.col("dataset_id").alias("src_dataset"))
    visible = chunks.where("is_active").join(gen, "dataset_id").where(now).join(live_docs, "document_id").where("doc_dataset = dataset_id and doc_generation = generation")
    visible = visible.join(live_src, "source_id").where("src_dataset = dataset_id").groupBy("dataset_id").agg(F.count("*").alias("chunks_active"))
    parts = [
        per(sources, sources_total=every, sources_active=F.col("status") == "active"),
        per(documents, documents_total=every, documents_active=now & F.col("is_active")),
        per(chunks, chunks_total=every),
        visible,
    ]
    if entities is not None:
        parts.append(per(entities, entities_active_current_generation=now & F.col("is_active")))
    if relations is not None and entities is not None:
        parts.append(current_relation_count(relations, entities, gen))
    if summaries is not None:
        parts.append(per(summaries, summaries_total=every))
    out = reduce(lambda a, b: a.join(b, "dataset_id", "left"), parts, datasets.select("dataset_id"))
    return out.na.fill(0)


def current_relation_count(relations: DataFrame, entities: DataFrame, gen: DataFrame) -> DataFrame:
    """Current relations with both ends current, for each dataset."""
    live = entities.where("is_active").join(gen, "dataset_id").where("generation = active_generation").select("entity_id", "dataset_id")
    rows = relations.where("is_active").join(gen, "dataset_id").where("generation = active_generation")
    for end in ("source_entity_id", "target_entity_id"):
        rows = rows.join(live.select(F.col("entity_id").alias(end), "dataset_id"), [end, "dataset_id"], "left_semi")
    return rows.groupBy("dataset_id").agg(F.count("*").alias("relations_active_current_generation"))


def sorted_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values in order."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    """D04."""
    return df.select(col).distinct()


def incident_entities(relations: DataFrame, entity_ids: DataFrame | None = None) -> DataFrame:
    """Entities at either end of a relation."""
    ends = relations.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).distinct()
    return ends if entity_ids is None else ends.join(entity_ids.select("entity_id").distinct(), "entity_id", "left_semi")


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    """D07."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """one page in a total order."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative and limit must be positive")
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    """The count beside a page."""
    return df.agg(F.count("*").alias("total"))


def run_counters(**counts: Column | str) -> list[Column]:
    """Counters of a run as aggregates of one result row, for ``observe`` or ``agg``."""
    return [F.count_if(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in counts.items()]


def capped(df: DataFrame, keys: list[str], order: list, cap: int = 50) -> DataFrame:
    """at most ``cap`` rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def oldest_candidates(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """a bounded scan for work, oldest first."""
    return df.orderBy(*order).limit(limit)

"""Authoritative, generation-scoped views and the filters on them.

A row is visible if its dataset is active, its generation is the dataset's
active one, it is active itself and its source is active. Datasets are a small
dimension: their columns are narrow and Spark's own size check decides whether
they are broadcast; nothing here forces it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_COLUMNS = ("chunk_id", "dataset_id", "source_id", "source_name", "document_id", "generation", "ordinal", "text", "start_char", "end_char")


def current_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.where("status = 'active'").select("dataset_id", "active_generation")


def among(df: DataFrame, col: str, values: Sequence | DataFrame | None) -> DataFrame:
    """Rows whose ``col`` is one of the values; no or empty values filter nothing. A DataFrame of values is semi-joined."""
    if values is None:
        return df
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(col)), col, "left_semi")
    return df.where(F.col(col).isin(list(values))) if values else df


def created_between(df: DataFrame, after: datetime | None = None, before: datetime | None = None, col: str = "created_at") -> DataFrame:
    """Both ends included."""
    if after is not None:
        df = df.where(F.col(col) >= F.lit(after))
    if before is not None:
        df = df.where(F.col(col) <= F.lit(before))
    return df


def contains_metadata(metadata: Column, wanted: dict) -> Column:
    """JSON text contains the given object: scalars by typed paths natively, nested values and arrays piece by piece."""
    v = F.try_parse_json(metadata)

    def at(path: str, value) -> Column:
        if isinstance(value, dict):
            ok = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT"), F.lit(False))
            for k, x in value.items():
                ok = ok & at(f"{path}['{k}']", x)
            return ok
        if isinstance(value, list):
            ok = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY"), F.lit(False))
            for x in value:
                if isinstance(x, (dict, list)):
                    raise ValueError("arrays of objects are matched by contains_json")
                kind = _kind(x)
                ok = ok & F.coalesce(F.array_contains(F.try_variant_get(v, path, f"array<{kind}>"), F.lit(x)), F.lit(False))
            return ok
        if value is None:
            return F.coalesce(F.is_variant_null(F.try_variant_get(v, path, "variant")), F.lit(False))
        typed = F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))
        same_kind = typed == "STRING" if isinstance(value, str) else typed == "BOOLEAN" if isinstance(value, bool) else ~typed.isin("STRING", "BOOLEAN", "VOID", "")
        return same_kind & F.coalesce(F.try_variant_get(v, path, _kind(value)) == F.lit(value), F.lit(False))

    return at("$", wanted)


def _kind(x) -> str:
    return "boolean" if isinstance(x, bool) else "double" if isinstance(x, (int, float)) else "string"


def contains_json(metadata: Column, wanted: dict) -> Column:
    """B05 for arrays of objects: Arrow-batched containment of any JSON."""
    def inside(big, small) -> bool:
        if isinstance(small, dict):
            return isinstance(big, dict) and all(k in big and inside(big[k], v) for k, v in small.items())
        if isinstance(small, list):
            return isinstance(big, list) and all(any(inside(b, s) for b in big) for s in small)
        return type(big) is type(small) and big == small or (isinstance(big, (int, float)) and isinstance(small, (int, float)) and not isinstance(big, bool) and not isinstance(small, bool) and big == small)

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x is not None and inside(json.loads(x), wanted))

    return run(metadata)


def authoritative_chunks(
    chunks: DataFrame, documents: DataFrame, sources: DataFrame, datasets: DataFrame, *, dataset_ids: Sequence | DataFrame | None = None,
    source_ids: Sequence | DataFrame | None = None, created_after: datetime | None = None, created_before: datetime | None = None, metadata: Column | None = None,
) -> DataFrame:
    """B01 with B03-B05, C01: visible chunks with the name of their source."""
    live = current_datasets(datasets)
    src = created_between(among(sources.where("status = 'active'"), "source_id", source_ids), created_after, created_before)
    if metadata is not None:
        src = src.where(metadata)
    src = src.select("source_id", F.col("dataset_id").alias("src_dataset"), F.col("name").alias("source_name"))
    docs = documents.where("is_active").select("document_id", F.col("dataset_id").alias("doc_dataset"), F.col("generation").alias("doc_generation"))
    rows = among(chunks.where("is_active"), "dataset_id", dataset_ids).join(live, "dataset_id").where("generation = active_generation")
    rows = rows.join(docs, "document_id").where("doc_dataset = dataset_id and doc_generation = active_generation")
    rows = rows.join(src, "source_id").where("src_dataset = dataset_id")
    extra = [c for c in ("embedding", "lexical") if c in chunks.columns]
    return rows.select(*CHUNK_COLUMNS, *extra)


def authoritative_summaries(summaries: DataFrame, documents: DataFrame, sources: DataFrame, datasets: DataFrame, *, dataset_ids=None) -> DataFrame:
    """Visible document summaries."""
    docs = documents.where("is_active").select("document_id", "source_id", F.col("dataset_id").alias("doc_dataset"), F.col("generation").alias("doc_generation"))
    src = sources.where("status = 'active'").select("source_id", F.col("dataset_id").alias("src_dataset"), F.col("name").alias("source_name"))
    rows = among(summaries.where("is_active"), "dataset_id", dataset_ids).join(current_datasets(datasets), "dataset_id").where("generation = active_generation")
    if "level" in summaries.columns:
        rows = rows.where("level = 0 and target_type = 'document'")
    rows = rows.join(docs, "document_id").where("doc_dataset = dataset_id and doc_generation = active_generation").join(src, "source_id").where("src_dataset = dataset_id")
    return rows.select("summary_id", "dataset_id", "source_id", "source_name", "document_id", "generation", "text", "embedding")


def resolve_datasets(spark: SparkSession, datasets: DataFrame, slugs: Sequence[str], *, strict: bool = True) -> DataFrame:
    """Ids of active datasets in the order asked for, without repeats. A slug that names none raises when the rows are read (``strict``), else comes back with a null id."""
    asked = spark.createDataFrame([(i, s) for i, s in enumerate(dict.fromkeys(slugs))], "position int, slug string")
    rows = asked.join(datasets.where("status = 'active'").select("slug", "dataset_id", "active_generation"), "slug", "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit("dataset not found: "), F.col("slug")))
        rows = rows.withColumn("dataset_id", F.when(F.col("dataset_id").isNull(), missing.cast(datasets.schema["dataset_id"].dataType)).otherwise(F.col("dataset_id")))
    return rows.select("position", "slug", "dataset_id", "active_generation").orderBy("position")


def active_entities(entities: DataFrame, datasets: DataFrame, ids=None) -> DataFrame:
    """B07."""
    rows = among(entities.where("is_active"), "entity_id", ids).join(current_datasets(datasets), "dataset_id").where("generation = active_generation")
    return rows.drop("active_generation")


def active_relations(relations: DataFrame, entities: DataFrame, datasets: DataFrame, ids=None) -> DataFrame:
    """Relations that are current and whose ends are current in the same dataset."""
    live = active_entities(entities, datasets).select("entity_id", F.col("dataset_id").alias("end_dataset"))
    rows = among(relations.where("is_active"), "relation_id", ids).join(current_datasets(datasets), "dataset_id").where("generation = active_generation").drop("active_generation")
    for end in ("source_entity_id", "target_entity_id"):
        rows = rows.join(live.select(F.col("entity_id").alias(end), "end_dataset"), end).where("end_dataset = dataset_id").drop("end_dataset")
    return rows


def entities_without_vector(entities: DataFrame, datasets: DataFrame) -> DataFrame:
    """Current entities to embed, by id."""
    return active_entities(entities, datasets).where("embedding is null").select("entity_id", "dataset_id", "name").orderBy("entity_id")


def relations_without_vector(relations: DataFrame, entities: DataFrame, datasets: DataFrame) -> DataFrame:
    """Current relations to embed, with the names of their ends."""
    name = entities.select("entity_id", "name")
    rows = active_relations(relations, entities, datasets).where("embedding is null")
    rows = rows.join(name.select(F.col("entity_id").alias("source_entity_id"), F.col("name").alias("source_name")), "source_entity_id")
    rows = rows.join(name.select(F.col("entity_id").alias("target_entity_id"), F.col("name").alias("target_name")), "target_entity_id")
    return rows.select("relation_id", "dataset_id", "source_name", "predicate", "description", "target_name").orderBy("relation_id")


def covers_dataset(dataset_ids: Column, dataset_id) -> Column:
    """B10."""
    return F.array_contains(dataset_ids, dataset_id)


def differs(a: Column, b) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def precedes(created: Column, id_: Column, other_created, other_id) -> Column:
    """(created, id) < (other_created, other_id) as one row value."""
    return F.struct(created.alias("a"), id_.alias("b")) < F.struct(F.lit(other_created).alias("a"), F.lit(other_id).alias("b"))


def eligible(next_attempt: Column, as_of: Column) -> Column:
    """B13."""
    return next_attempt.isNull() | (next_attempt <= as_of)


def stale(at: Column, as_of: Column, seconds: float, *, null_is_stale: bool) -> Column:
    """Strictly older than ``seconds`` before ``as_of``."""
    old = at < as_of - F.make_dt_interval(secs=F.lit(seconds))
    return F.coalesce(old, F.lit(null_is_stale))


def with_status(df: DataFrame, *statuses: str) -> DataFrame:
    """B15."""
    return df.where(F.col("status").isin(*statuses))


COGNIFIABLE = ("pending", "failed")


def cognify_candidates(sources: DataFrame, *, force: bool = False) -> DataFrame:
    """Sources a run takes up: pending and failed ones, with ``force`` every one not deleted; oldest first."""
    rows = sources.where("status <> 'deleted'") if force else with_status(sources, *COGNIFIABLE)
    return rows.orderBy("created_at", "source_id")


def lookup(df: DataFrame, **equal) -> DataFrame:
    """At most one row that has the given values."""
    for k, v in equal.items():
        df = df.where(F.col(k) == F.lit(v))
    return df.limit(1)


def not_yet(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key does not exist."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def exists(df: DataFrame) -> bool:
    """Whether there is a row; reads no more than one."""
    return not df.isEmpty()


def of_generation(df: DataFrame, source_id, generation: int, *, active_only: bool = False) -> DataFrame:
    """Documents or chunks of one source and generation, ordered."""
    rows = df.where((F.col("source_id") == source_id) & (F.col("generation") == generation))
    if active_only:
        rows = rows.where("is_active")
    order = [c for c in ("document_id", "ordinal", "created_at", "chunk_id") if c in df.columns]
    return rows.orderBy(*order)


def forget_summaries(summaries: DataFrame, documents: DataFrame | None, entities: DataFrame | None, datasets: DataFrame | None) -> DataFrame:
    """Active summaries of forgotten documents, entities or datasets: one semi-join on (target_type, target_id)."""
    keys = None
    for kind, df in (("document", documents), ("entity", entities), ("dataset", datasets)):
        if df is not None:
            part = df.select(F.lit(kind).alias("target_type"), F.col(df.columns[0]).cast("string").alias("target_id"))
            keys = part if keys is None else keys.union(part)
    if keys is None:
        return summaries.where("false")
    return summaries.where("is_active").join(keys.distinct(), ["target_type", "target_id"], "left_semi")


def references(scope: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Visible chunks for many ids in one join."""
    return scope.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def work_items(runs: DataFrame, **filters) -> DataFrame:
    """Runs by any of status, dataset_id, pipeline_type and so on; filters add up, None filters nothing; newest first."""
    for k, v in filters.items():
        if v is not None:
            runs = runs.where(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v))
    return runs.orderBy(F.desc("created_at"), F.desc("run_id"))


def authoritative_mentions(mentions: DataFrame, scope: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Mentions whose chunk is visible (and whose entity is current, where entities are given)."""
    rows = mentions.join(scope.select("chunk_id", F.col("dataset_id").alias("chunk_dataset")), "chunk_id")
    if entities is not None:
        rows = rows.join(entities.select("entity_id", F.col("dataset_id").alias("entity_dataset")), "entity_id").where("entity_dataset = chunk_dataset").drop("entity_dataset")
    return rows


def authoritative_evidence(evidence: DataFrame, scope: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Evidence whose chunk is visible (and whose relation is current, where relations are given)."""
    rows = evidence.join(scope.select("chunk_id", F.col("dataset_id").alias("chunk_dataset")), "chunk_id")
    if relations is not None:
        rows = rows.join(relations.select("relation_id", F.col("dataset_id").alias("relation_dataset")), "relation_id").where("relation_dataset = chunk_dataset").drop("relation_dataset")
    return rows


def hydrated_evidence(evidence: DataFrame, scope: DataFrame, relation_ids: DataFrame | None = None) -> DataFrame:
    """Visible evidence with its chunk's place, ordered by relation, falling confidence and chunk."""
    if relation_ids is not None:
        evidence = evidence.join(relation_ids.select("relation_id").distinct(), "relation_id", "left_semi")
    return evidence.join(scope.drop("embedding", "lexical"), "chunk_id").orderBy("relation_id", F.desc("confidence"), "chunk_id")


def summary_inputs(documents: DataFrame, sources: DataFrame, datasets: DataFrame) -> DataFrame:
    """Current documents of active sources, for rebuilding summaries."""
    rows = documents.where("is_active").join(current_datasets(datasets), "dataset_id").where("generation = active_generation")
    src = sources.where("status = 'active'").select("source_id", F.col("dataset_id").alias("src_dataset"), F.col("name").alias("source_name"))
    return rows.join(src, "source_id").where("src_dataset = dataset_id").drop("src_dataset", "active_generation")

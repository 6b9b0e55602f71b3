"""The fifteen authoritative tables, their value sets and row constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _B, _F = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.FloatType()
_TS, _V, _SS = T.TimestampType(), T.ArrayType(T.FloatType()), T.ArrayType(T.StringType())


def _table(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


#: Free-form columns are JSON text; vectors are arrays of float; ids are lower-case UUID text.
DDL = {
    "datasets": "id string, name string, slug string, description string, status string, active_generation int, metadata string, created_at timestamp, updated_at timestamp",
    "sources": "id string, dataset_id string, kind string, original_name string, storage_uri string, source_uri string, mime_type string, content_sha256 string, size_bytes bigint, version int, status string, metadata string, created_at timestamp, updated_at timestamp",
    "documents": "id string, source_id string, dataset_id string, title string, normalized_text string, normalized_sha256 string, language string, generation int, metadata string, is_active boolean, created_at timestamp",
    "chunks": "id string, document_id string, source_id string, dataset_id string, generation int, ordinal int, text string, content_sha256 string, token_count int, start_char int, end_char int, section_path array<string>, metadata string, embedding array<float>, lexical map<string,array<int>>, is_active boolean, created_at timestamp",
    "entities": "id string, dataset_id string, canonical_key string, name string, entity_type string, description string, aliases array<string>, properties string, confidence float, importance_weight float, embedding array<float>, generation int, is_active boolean, created_at timestamp",
    "entity_mentions": "id string, entity_id string, chunk_id string, surface_text string, start_char int, end_char int, confidence float, generation int, created_at timestamp",
    "relations": "id string, dataset_id string, source_entity_id string, target_entity_id string, predicate string, description string, properties string, confidence float, importance_weight float, embedding array<float>, generation int, is_active boolean, created_at timestamp",
    "relation_evidence": "relation_id string, chunk_id string, quote string, confidence float, created_at timestamp",
    "summaries": "id string, dataset_id string, target_type string, target_id string, level int, text string, embedding array<float>, generation int, properties string, is_active boolean, created_at timestamp",
    "memory_entries": "id string, dataset_id string, session_id string, kind string, content string, metadata string, created_at timestamp",
    "queries": "id string, dataset_ids array<string>, query_text string, answer_text string, mode string, references string, timings string, created_at timestamp",
    "feedback": "id string, query_id string, target_type string, target_id string, score smallint, comment string, applied_at timestamp, created_at timestamp",
    "pipeline_runs": "id string, dataset_id string, source_id string, pipeline_type string, status string, idempotency_key string, payload_hash string, config_fingerprint string, input string, output string, progress float, attempt int, worker_id string, error_code string, error_message string, next_attempt_at timestamp, heartbeat_at timestamp, created_at timestamp, started_at timestamp, finished_at timestamp, retry_of_run_id string",
    "pipeline_steps": "id string, run_id string, name string, position int, status string, attempt int, input_hash string, output string, metrics string, error string, started_at timestamp, finished_at timestamp",
    "graph_outbox": "id bigint, dataset_id string, aggregate_type string, aggregate_id string, operation string, payload string, status string, attempt int, worker_id string, processing_started_at timestamp, error string, created_at timestamp",
}

#: The states and kinds a column may hold.
VALUES = {
    "datasets.status": ("active", "deleting", "deleted"),
    "sources.status": ("pending", "processing", "active", "failed", "deleted"),
    "summaries.target_type": ("document", "entity", "cluster", "dataset"),
    "feedback.target_type": ("answer", "reference"),
    "feedback.score": (-1, 0, 1),
    "pipeline_runs.status": ("queued", "running", "succeeded", "failed", "cancelling", "cancelled"),
    "pipeline_steps.status": ("queued", "running", "succeeded", "failed", "cancelled"),
    "graph_outbox.status": ("pending", "processing", "done", "failed"),
    "graph_outbox.operation": ("upsert", "delete"),
    "graph_outbox.aggregate_type": ("entity", "chunk", "entity_mention", "relation", "chunk_next"),
}

#: Conditions every row must meet, as SQL.
CHECKS = {
    "chunks": ("start_char >= 0", "end_char >= start_char", "ordinal >= 0", "token_count >= 0"),
    "entity_mentions": ("(start_char is null) = (end_char is null)", "start_char is null or end_char >= start_char", "confidence between 0 and 1"),
    "entities": ("confidence between 0 and 1", "importance_weight between 0 and 1"),
    "relations": ("confidence between 0 and 1", "importance_weight between 0 and 1"),
    "relation_evidence": ("confidence between 0 and 1",),
    "sources": ("content_sha256 rlike '^[0-9a-f]{64}$'", "version >= 1", "size_bytes >= 0"),
    "pipeline_runs": ("progress between 0 and 1", "attempt >= 0"),
    "pipeline_steps": ("attempt >= 0",),
    "graph_outbox": ("attempt >= 0",),
}

#: Columns that name one row; with a condition, among the rows that meet it.
UNIQUE = {
    "sources": (("dataset_id", "content_sha256", "version"), None),
    "chunks": (("document_id", "generation", "ordinal"), None),
    "entities": (("dataset_id", "canonical_key"), "is_active"),
    "relation_evidence": (("relation_id", "chunk_id"), None),
    "datasets": (("slug",), None),
}


def schema(name: str) -> T.StructType:
    return _table(DDL[name])


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan of one authoritative table with its declared schema."""
    return spark.read.schema(schema(name)).parquet(f"{root}/{name}")


def read_all(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read(spark, root, name) for name in DDL}


def violations(df: DataFrame, name: str) -> DataFrame:
    """Rows that break a constraint, with the list of the broken ones; valid tables give none."""
    tests: list[tuple[str, Column]] = [(c, F.expr(c)) for c in CHECKS.get(name, ())]
    for key, allowed in VALUES.items():
        table, col = key.split(".")
        if table == name and col in df.columns:
            tests.append((f"{col} in {allowed}", F.col(col).isin(*allowed)))
    if not tests:
        return df.where("false").withColumn("broken", F.array().cast("array<string>"))
    broken = F.filter(F.array(*(F.when(~F.coalesce(t, F.lit(True)), F.lit(text)) for text, t in tests)), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Keys that name more than one row."""
    keys, where = UNIQUE[name]
    rows = df.where(where) if where else df
    return rows.groupBy(*keys).count().where("count > 1")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

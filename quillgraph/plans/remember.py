"""Q06, Q07, Q11, Q24, Q25: ingest, idempotency, feedback, datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import dataset_slug, parse_references, uuid5
from ..operators.listing import page
from ..sources.loaders import prepared_text

MAIN = "main"
SOURCE_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"  # of name-based ids


def remembered(items: DataFrame, sources: DataFrame, *, force: bool = False) -> DataFrame:
    """``items(dataset_id, name, text, created_at)`` with hashes, ``outcome`` and ``version``.

    Content that its dataset holds (in a source that is not deleted), or that
    came earlier in the same batch, is a duplicate of the source in
    ``source_id``; with ``force`` it becomes the next version. Ids are named by
    dataset, content and version, so a rerun writes the same rows.
    """
    rows = prepared_text(items)
    held = sources.where("status <> 'deleted'").groupBy("dataset_id", "content_sha256").agg(F.max_by("source_id", F.struct("version", "source_id")).alias("held_id"))
    top = sources.groupBy("dataset_id", "content_sha256").agg(F.max("version").alias("top"))
    w = Window.partitionBy("dataset_id", "content_sha256").orderBy("created_at", "name")
    rows = rows.withColumn("n", F.row_number().over(w)).join(held, ["dataset_id", "content_sha256"], "left").join(top, ["dataset_id", "content_sha256"], "left")
    fresh = F.lit(True) if force else F.col("held_id").isNull() & (F.col("n") == 1)
    version = (F.coalesce("top", F.lit(0)) + (F.col("n") if force else F.lit(1))).cast("int")
    new_id = uuid5(SOURCE_NAMESPACE, F.concat_ws(":", F.col("dataset_id").cast("string"), "content_sha256", version.cast("string")))
    return rows.select(
        *items.columns, "normalized_text", "content_sha256", "normalized_sha256", "byte_size", F.when(fresh, "created").otherwise("duplicate").alias("outcome"),
        F.when(fresh, version).alias("version"), F.when(fresh | F.col("held_id").isNull(), new_id).otherwise(F.col("held_id").cast("string")).alias("source_id"),
    )


def idempotent(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Q07: ``requests(idempotency_key, payload_hash)`` with ``decision``: run, replay (the stored result) or conflict."""
    held = runs.where("idempotency_key is not null").select("idempotency_key", F.col("payload_hash").alias("held_hash"), F.col("status").alias("held_status"), F.col("output").alias("held_output"))
    rows = requests.join(held, "idempotency_key", "left")
    same = F.col("held_hash") == F.col("payload_hash")
    decision = F.when(F.col("held_hash").isNull(), "run").when(same & (F.col("held_status") == "succeeded"), "replay").otherwise("conflict")
    return rows.select(*requests.columns, decision.alias("decision"), F.when(decision == "replay", F.col("held_output")).alias("output"))


def checked_feedback(feedback: DataFrame, queries: DataFrame) -> DataFrame:
    """Q11: feedback with ``error``: unknown query, bad score, or a reference that its query does not have."""
    q = queries.select("query_id", F.transform(parse_references(F.col("references")), lambda x: x["chunk_id"]).alias("_refs"), F.lit(True).alias("_known"))
    rows = feedback.join(q, "query_id", "left")
    bad_target = F.when(F.col("target_type") == "reference", F.col("target_id").isNull() | ~F.array_contains("_refs", F.col("target_id").cast("string"))).when(F.col("target_type") == "answer", F.col("target_id").isNotNull()).otherwise(F.lit(True))
    error = F.when(F.col("_known").isNull(), "unknown query").when(~F.coalesce(F.col("score").isin(-1, 0, 1), F.lit(False)), "bad score").when(F.coalesce(bad_target, F.lit(True)), "bad target")
    return rows.select(*feedback.columns, error.alias("error"))


def created_datasets(requests: DataFrame, datasets: DataFrame) -> DataFrame:
    """``requests(name)`` with slug and ``error``; names collide without regard to case, slugs exactly, also inside the batch."""
    rows = requests.withColumn("slug", dataset_slug(F.col("name"))).withColumn("_key", F.lower(F.trim("name")))
    names = datasets.select(F.lower(F.trim("name")).alias("_key"), F.lit(True).alias("_name_held"))
    slugs = datasets.select("slug", F.lit(True).alias("_slug_held"))
    rows = rows.join(names.distinct(), "_key", "left").join(slugs.distinct(), "slug", "left")
    first_name = F.row_number().over(Window.partitionBy("_key").orderBy("name")) == 1
    first_slug = F.row_number().over(Window.partitionBy("slug").orderBy("name")) == 1
    error = F.when(F.col("slug").isNull(), "invalid name").when(F.col("_name_held") | ~first_name, "name exists").when(F.col("_slug_held") | ~first_slug, "slug exists")
    return rows.select(*requests.columns, "slug", error.alias("error"))


def renamed_dataset(datasets: DataFrame, dataset_id, name: str) -> DataFrame:
    """Q24: a new name; the slug stays. Raises for an unknown dataset, a held name, and for the reserved one."""
    me = datasets.where(F.col("dataset_id") == F.lit(dataset_id)).first()
    if me is None:
        raise LookupError("dataset not found")
    if me["slug"] == MAIN:
        raise ValueError("the main dataset keeps its name")
    if not datasets.where((F.col("dataset_id") != F.lit(dataset_id)) & (F.lower(F.trim("name")) == name.strip().lower())).isEmpty():
        raise ValueError("name exists")
    return datasets.withColumn("name", F.when(F.col("dataset_id") == F.lit(dataset_id), F.lit(name.strip())).otherwise(F.col("name")))


def main_dataset(datasets: DataFrame) -> DataFrame:
    """Q06: datasets with ``main``, which is made when it is missing."""
    spark = datasets.sparkSession
    made = spark.createDataFrame([(MAIN, MAIN, "active", 1)], "dataset_id string, slug string, status string, active_generation int")
    return datasets.unionByName(made.join(datasets.select("slug"), "slug", "left_anti"), allowMissingColumns=True)


def dataset_page(datasets: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """Newest first where there is a creation time, else by id."""
    order = [F.desc("created_at"), "dataset_id"] if "created_at" in datasets.columns else ["dataset_id"]
    return page(datasets, order, offset, limit)


def source_page(sources: DataFrame, dataset_id, offset: int = 0, limit: int = 20) -> DataFrame:
    return page(sources.where(F.col("dataset_id") == F.lit(dataset_id)), [F.desc("created_at"), "source_id"], offset, limit)

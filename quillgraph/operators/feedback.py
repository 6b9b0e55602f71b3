"""Feedback folded into importance weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import clamp_weight, effective_importance, feedback_value, updated_weight
from ..functions.scalars import parse_references


def unapplied(feedback: DataFrame, queries: DataFrame, dataset_id=None) -> DataFrame:
    """Feedback not applied yet, with the references of its query; oldest first."""
    rows = feedback.where("applied_at is null").join(queries.select("query_id", "dataset_ids", "references"), "query_id")
    if dataset_id is not None:
        rows = rows.where(F.array_contains("dataset_ids", dataset_id))
    return rows.orderBy("created_at", "feedback_id")


def target_chunks(feedback: DataFrame) -> DataFrame:
    """Q13: (feedback_id, created_at, score, chunk_id): the reference itself, or every reference of an answer."""
    refs = F.transform(parse_references(F.col("references")), lambda x: x["chunk_id"])
    ids = F.when(F.col("target_type") == "reference", F.array(F.col("target_id").cast("string"))).otherwise(refs)
    rows = feedback.select("feedback_id", "created_at", "score", F.explode(F.array_distinct(ids)).alias("chunk_id"))
    return rows.where("chunk_id is not null")


def folded(start: Column, scores: Column, alpha: float = 0.1) -> Column:
    """The weight after feedback in order. ``scores``: ordered array of -1, 0, 1. Rounding each step makes the order count, so there is no partial sum."""
    return F.aggregate(scores, start.cast("double"), lambda w, z: updated_weight(w, feedback_value(z), alpha))


def fold_by(feedback: DataFrame, key: str, order: list[str], start: Column | float = 0.5) -> DataFrame:
    """(key, weight). The feedback of one target is what people gave for it; it is sorted and folded in one array."""
    got = feedback.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "score"))), lambda x: x["score"]).alias("scores"))
    return got.select(key, folded(F.lit(start) if isinstance(start, (int, float)) else start, F.col("scores")).alias("weight"), F.size("scores").alias("n_feedback"))


def weights_after(items: DataFrame, targets: DataFrame, id_col: str) -> DataFrame:
    """Q13: items with feedback: new importance_weight (and feedback_weight where a marker split it) after folding.

    ``targets``: feedback_id, created_at, score, <id_col>. Items: <id_col>,
    importance_weight, and optionally feedback_weight and centrality_weight of
    a valid marker (null: none).
    """
    got = targets.select(id_col, "created_at", "feedback_id", "score").distinct().groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "feedback_id", "score"))), lambda x: x["score"]).alias("_scores"))
    rows = items.join(got, id_col)
    if "feedback_weight" not in items.columns:
        return rows.withColumn("importance_weight", folded(F.col("importance_weight"), F.col("_scores"))).drop("_scores")
    marked = F.col("feedback_weight").isNotNull()
    part = folded(clamp_weight(F.col("feedback_weight").cast("double")), F.col("_scores"))
    whole = folded(F.col("importance_weight"), F.col("_scores"))
    rows = rows.withColumn("_part", part)
    rows = rows.withColumn("importance_weight", F.when(marked, effective_importance(F.col("_part"), F.col("centrality_weight").cast("double"))).otherwise(whole))
    return rows.withColumn("feedback_weight", F.when(marked, F.col("_part"))).drop("_part", "_scores")


def outcome(feedback: DataFrame, hit: DataFrame) -> DataFrame:
    """Q13: applied or skipped for each feedback; both count as consumed. ``hit``: feedback_id with an entity or relation behind it."""
    rows = feedback.select("feedback_id").join(hit.select("feedback_id").distinct().withColumn("_hit", F.lit(True)), "feedback_id", "left")
    return rows.select("feedback_id", F.when(F.col("_hit"), "applied").otherwise("skipped").alias("outcome"))

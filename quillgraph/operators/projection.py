"""Projection of the authoritative rows onto the graph: commands, application, rebuild, reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shares
from .graph import next_edges

#: The kinds of rows in the order they depend on each other.
ORDER = ("entity", "chunk", "entity_mention", "relation", "chunk_next")
NODES, EDGES = ("entity", "chunk"), ("entity_mention", "relation", "chunk_next")
COMMAND = ("dataset_id", "aggregate_type", "aggregate_id", "operation", "source_id", "target_id", "payload")


def dependency_order(col: Column) -> Column:
    """0 to 4 for the known kinds, 5 for others."""
    out = F.lit(len(ORDER))
    for i, k in enumerate(ORDER):
        out = F.when(col == k, i).otherwise(out)
    return out


def command(kind: str, operation: str, aggregate_id: Column, dataset_id: Column, source: Column | None = None, target: Column | None = None, payload: Column | None = None) -> list[Column]:
    """The columns of one projection command."""
    null = F.lit(None).cast("string")
    text = lambda c: null if c is None else c.cast("string")
    return [
        dataset_id.cast("string").alias("dataset_id"), F.lit(kind).alias("aggregate_type"), aggregate_id.cast("string").alias("aggregate_id"), F.lit(operation).alias("operation"),
        text(source).alias("source_id"), text(target).alias("target_id"), (null if payload is None else F.to_json(payload)).alias("payload"),
    ]


def valid_command() -> Column:
    """Kind and operation known, identities there, ends there exactly for edges, an upsert of a node with a payload."""
    edge = F.col("aggregate_type").isin(*EDGES)
    ends = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    ok = F.col("aggregate_type").isin(*ORDER) & F.col("operation").isin("upsert", "delete") & F.col("aggregate_id").isNotNull() & F.col("dataset_id").isNotNull()
    return F.coalesce(ok & (edge == ends) & (edge | (F.col("operation") == "delete") | F.col("payload").isNotNull()), F.lit(False))


def split_invalid(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    return commands.where(valid_command()), commands.where(~valid_command())


def once(commands: DataFrame, order: list[str], *, last: bool) -> DataFrame:
    """One command for each identity: the last (extraction) or the first (forgetting)."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    w = Window.partitionBy("dataset_id", "aggregate_type", "aggregate_id").orderBy(*by)
    return commands.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_state(commands: DataFrame, id_col: str = "id") -> DataFrame:
    """The latest command of each aggregate. ``max_by`` is combined before the shuffle, so a hot aggregate costs one row a task."""
    rest = [c for c in commands.columns if c not in ("dataset_id", "aggregate_type", "aggregate_id")]
    latest = F.max_by(F.struct(*rest), id_col).alias("r")
    return commands.groupBy("dataset_id", "aggregate_type", "aggregate_id").agg(latest).select("dataset_id", "aggregate_type", "aggregate_id", "r.*")


def applied(state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, missing ends) after the latest commands. An edge goes with either of its nodes; one whose node never came is an error."""
    live = state.where("operation = 'upsert'")
    nodes = live.where(F.col("aggregate_type").isin(*NODES))
    edges = live.where(F.col("aggregate_type").isin(*EDGES))
    ids = nodes.select("dataset_id", F.col("aggregate_id").alias("_i")).distinct()
    whole = edges.join(ids.withColumnRenamed("_i", "source_id"), ["dataset_id", "source_id"], "left_semi").join(ids.withColumnRenamed("_i", "target_id"), ["dataset_id", "target_id"], "left_semi")
    ever = state.where(F.col("aggregate_type").isin(*NODES)).select("dataset_id", F.col("aggregate_id").alias("_i")).distinct()
    missing = edges.join(ever.withColumnRenamed("_i", "source_id"), ["dataset_id", "source_id"], "left_anti").unionByName(edges.join(ever.withColumnRenamed("_i", "target_id"), ["dataset_id", "target_id"], "left_anti")).distinct()
    return nodes, whole, missing


def wiped(graph: DataFrame, dataset_ids: DataFrame | None = None) -> DataFrame:
    """Graph rows without those of some datasets (of all, if none are named)."""
    return graph.where("false") if dataset_ids is None else graph.join(dataset_ids.select("dataset_id").distinct(), "dataset_id", "left_anti")


def rebuilt(datasets: DataFrame, entities: DataFrame, chunks: DataFrame, mentions: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """The five projections of the authoritative rows: current, active, with both ends in their own dataset."""
    gen = datasets.where("status = 'active'").select("dataset_id", "active_generation")
    now = lambda df: df.where("is_active").join(gen, "dataset_id").where("generation = active_generation").drop("active_generation")
    ent, chk = now(entities), now(chunks)
    e = ent.select("dataset_id", F.col("entity_id").alias("_e"))
    men = mentions.join(chk.select("dataset_id", "chunk_id"), "chunk_id").join(e.withColumnRenamed("_e", "entity_id"), ["dataset_id", "entity_id"], "left_semi")
    rel = now(relations).join(e.withColumnRenamed("_e", "source_entity_id"), ["dataset_id", "source_entity_id"], "left_semi").join(e.withColumnRenamed("_e", "target_entity_id"), ["dataset_id", "target_entity_id"], "left_semi")
    each = lambda df, id_: df.select("dataset_id", id_.alias("id")).repartition(shares(df.sparkSession), "dataset_id", "id").distinct()
    return {
        "entity": each(ent, F.col("entity_id").cast("string")),
        "chunk": each(chk, F.col("chunk_id").cast("string")),
        "entity_mention": each(men, F.concat_ws("@", "entity_id", "chunk_id")),
        "relation": each(rel, F.col("relation_id").cast("string")),
        "chunk_next": each(next_edges(chk), F.concat_ws(">", "chunk_id", "next_chunk_id")),
    }


def identities(parts: dict[str, DataFrame]) -> DataFrame:
    """(dataset_id, kind, id) of all projections; a row without an id keeps a sentinel so that it shows as a difference."""
    rows = [df.select("dataset_id", F.lit(k).alias("kind"), F.coalesce("id", F.lit(f"malformed_{k}")).alias("id")) for k, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def reconciled(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(dataset_id, kind, expected, actual, missing, extra), as a full outer join of the distinct identities would give it."""
    side = lambda df, a: df.select("dataset_id", "kind", "id", F.lit(a).alias("wanted"), F.lit(not a).alias("there"))
    return compared(side(expected, True).unionByName(side(actual, False)))


def compared(sides: DataFrame) -> DataFrame:
    """``reconciled`` for identities that say whether they are ``wanted``, ``there`` or both; an identity may come in several rows.

    Identities are dealt once and meet as equal keys of a grouping, which holds
    a share of them that is bounded by the partitions. Those with a null are
    equal to none of the other side.
    """
    keys = ["dataset_id", "kind", "id"]
    null = F.col("dataset_id").isNull() | F.col("kind").isNull() | F.col("id").isNull()
    one = lambda wanted, there: F.struct(wanted.alias("wanted"), there.alias("there"))
    apart = F.when(null & F.col("wanted") & F.col("there"), F.array(one(F.lit(True), F.lit(False)), one(F.lit(False), F.lit(True)))).otherwise(F.array(one(F.col("wanted"), F.col("there"))))
    rows = sides.select(*keys, F.explode(apart).alias("s")).select(*keys, "s.*").withColumn("lone", F.when(null, F.col("wanted")))
    rows = rows.repartition(shares(sides.sparkSession), *keys).groupBy(*keys, "lone").agg(F.max("wanted").alias("wanted"), F.max("there").alias("there"))
    return rows.groupBy("dataset_id", "kind").agg(
        F.count_if("wanted").alias("expected"), F.count_if("there").alias("actual"), F.count_if(~F.col("there")).alias("missing"), F.count_if(~F.col("wanted")).alias("extra"))


def reconcile(expected: DataFrame, actual: DataFrame, rebuild=None) -> tuple[DataFrame, str]:
    """Differences, and in_sync, rebuilt (``rebuild(expected)`` gave an equal graph) or raises if it still differs."""
    diff = reconciled(expected, actual)
    if diff.where("missing + extra > 0").isEmpty():
        return diff, "in_sync"
    if rebuild is None:
        return diff, "diverged"
    again = reconciled(expected, rebuild(expected))
    if not again.where("missing + extra > 0").isEmpty():
        raise RuntimeError("the projection still differs after a rebuild")
    return diff, "rebuilt"


def uniqueness(graph: DataFrame) -> DataFrame:
    """Identities that occur more than once."""
    return graph.groupBy("dataset_id", "kind", "id").count().where("count > 1")

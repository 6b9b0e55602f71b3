"""Entity deduplication: candidates, merge plan, application, relation rewiring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import folded_type
from ..functions.vectors import valid_components
from . import metric
from .graph import kept

CANDIDATE, MERGE = 0.90, 0.95
TILE = 1024  # rows of one side of a matrix product


def duplicate_candidates(entities: DataFrame, threshold: float = CANDIDATE, *, tile: int = TILE) -> DataFrame:
    """Pairs (entity_id < candidate_id) of one dataset and type with a cosine of at least ``threshold``.

    Exact: ``metric.similar_pairs`` over blocks of dataset, type and width. Large
    blocks are cut into cells around pivots, and a row travels to its own cell
    and to those that it may have partners in; a cell is compared in tiles of
    about ``tile`` rows, so a type that holds most entities is many tasks and
    only hits leave them. ``blocked_candidates`` is the approximate form. Vectors
    that are null, zero, of another length or with null or non-finite
    components are like no other.
    """
    known = "dataset_id" in entities.columns
    block = F.to_json(F.array((F.col("dataset_id") if known else F.lit(None)).cast("string"), folded_type(F.col("entity_type")), F.size("embedding").cast("string")))
    rows = entities.where("embedding is not null and size(embedding) > 0").where(folded_type(F.col("entity_type")).isNotNull()).where(valid_components(F.col("embedding"))).where(F.exists("embedding", lambda x: x != 0))
    pairs = metric.similar_pairs(rows.select(block.alias("block"), F.col("entity_id").alias("id"), "embedding"), threshold, tile=tile)
    return pairs.select(F.col("a").alias("entity_id"), F.col("b").alias("candidate_id"), "similarity").orderBy(F.desc("similarity"), "entity_id", "candidate_id")


def blocked_candidates(entities: DataFrame, threshold: float = CANDIDATE, *, bucket: float = 0.5, tables: int = 8) -> DataFrame:
    """C06, approximate and opt-in: only pairs that share a random-projection bucket are compared."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = entities.where("embedding is not null").select("entity_id", folded_type(F.col("entity_type")).alias("t"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    rows = Normalizer(inputCol="v", outputCol="u").transform(rows)
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=7).fit(rows)
    most = (2 - 2 * threshold) ** 0.5
    near = model.approxSimilarityJoin(rows, rows, most, "distance").where("datasetA.entity_id < datasetB.entity_id and datasetA.t = datasetB.t")
    return near.select(F.col("datasetA.entity_id").alias("entity_id"), F.col("datasetB.entity_id").alias("candidate_id"), (1 - F.col("distance") * F.col("distance") / 2).alias("similarity"))


def merge_plan(entities: DataFrame, candidates: DataFrame, order: tuple[str, ...] = ("created_rank", "entity_id")) -> DataFrame:
    """(entity_id, survivor_id). In order of creation every entity not yet absorbed absorbs its direct, not yet absorbed neighbours.

    That is the lexicographically first maximal independent set: a node
    survives once all its earlier neighbours are absorbed. Each round settles
    every node whose earlier neighbours are settled, for all components at once.
    """
    rank = entities.select("entity_id", F.struct(*order).alias("at"))
    a = candidates.select(F.col("entity_id").alias("x"), F.col("candidate_id").alias("y"))
    both = a.union(a.select("y", "x")).distinct()
    both = both.join(rank.select(F.col("entity_id").alias("x"), F.col("at").alias("at_x")), "x").join(rank.select(F.col("entity_id").alias("y"), F.col("at").alias("at_y")), "y")
    earlier = kept(both.where("at_y < at_x").select("x", "y", "at_y"))  # y comes before x
    open_ = kept(both.select("x").distinct())  # undecided: no earlier neighbour survives so far
    survivors = open_.where("false")
    while not open_.isEmpty():
        waits = earlier.join(open_.select(F.col("x").alias("y")), "y", "left_semi").select("x").distinct()
        ready = open_.join(waits, "x", "left_anti")
        survivors = kept(survivors.union(ready))
        hit = earlier.join(survivors.select(F.col("x").alias("y")), "y", "left_semi").select("x").distinct()
        open_ = kept(open_.join(survivors, "x", "left_anti").join(hit, "x", "left_anti"))
    taken = earlier.join(survivors.select(F.col("x").alias("y")), "y", "left_semi").groupBy("x").agg(F.min_by("y", "at_y").alias("survivor_id"))
    return taken.select(F.col("x").alias("entity_id"), "survivor_id")


def merged_aliases(entities: DataFrame, plan: DataFrame) -> DataFrame:
    """(entity_id, aliases) of survivors: own aliases, then for each absorbed entity its name and aliases; the first spelling of each stays, the survivor's name is left out."""
    own = entities.select(F.col("entity_id").alias("survivor_id"), F.col("name").alias("own_name"), "aliases").join(plan.select("survivor_id").distinct(), "survivor_id", "left_semi")
    first = own.select("survivor_id", F.lit(-1).cast("long").alias("turn"), F.posexplode("aliases").alias("pos", "alias"))
    order = F.struct(*[c for c in ("created_rank", "created_at", "entity_id") if c in entities.columns])
    lost = plan.join(entities.select("entity_id", "name", "aliases", order.alias("at")), "entity_id")
    lost = lost.withColumn("turn", F.row_number().over(Window.partitionBy("survivor_id").orderBy("at")).cast("long"))
    more = lost.select("survivor_id", "turn", F.posexplode(F.concat(F.array("name"), "aliases")).alias("pos", "alias"))
    rows = first.union(more).select("survivor_id", "turn", "pos", F.trim("alias").alias("alias")).where("length(alias) > 0")
    rows = rows.withColumn("key", F.lower("alias")).groupBy("survivor_id", "key").agg(F.min(F.struct("turn", "pos", "alias")).alias("f"))
    rows = rows.join(own.select("survivor_id", F.lower(F.trim("own_name")).alias("own_key")), "survivor_id").where("key <> own_key")
    return rows.groupBy("survivor_id").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["alias"]).alias("aliases")).withColumnRenamed("survivor_id", "entity_id")


def apply_merges(entities: DataFrame, mentions: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with absorbed ones inactive and survivors' aliases extended, and mentions moved to survivors."""
    out = entities.join(plan.select("entity_id", F.lit(True).alias("_gone")), "entity_id", "left")
    if "aliases" in entities.columns:
        more = merged_aliases(entities, plan).withColumnRenamed("aliases", "_aliases")
        out = out.join(more, "entity_id", "left").withColumn("aliases", F.coalesce("_aliases", "aliases")).drop("_aliases")
    active = F.col("is_active") if "is_active" in entities.columns else F.lit(True)
    out = out.withColumn("is_active", active & F.col("_gone").isNull()).drop("_gone")
    moved = mentions.join(plan, "entity_id", "left").withColumn("entity_id", F.coalesce("survivor_id", "entity_id")).drop("survivor_id").select(*mentions.columns)
    return out, moved


def rewired(relations: DataFrame, plan: DataFrame) -> DataFrame:
    """Every relation with its new ends and ``outcome``: kept, rewired, survivor, self_loop or merged.

    Ends go to survivors. A changed relation that became a self-loop is
    dropped; relations that now have equal ends and predicate (and generation)
    form a group with a change: the first stays - unchanged ones before changed
    ones, then by creation and id - with the group's highest confidence and
    weight, the others are merged into it.
    """
    m = plan.select(F.col("entity_id").alias("_e"), F.col("survivor_id").alias("_s"))
    rows = relations
    for end, new in (("source_entity_id", "new_source"), ("target_entity_id", "new_target")):
        rows = rows.join(m.withColumnRenamed("_e", end).withColumnRenamed("_s", new), end, "left").withColumn(new, F.coalesce(new, end))
    rows = rows.withColumn("changed", (F.col("new_source") != F.col("source_entity_id")) | (F.col("new_target") != F.col("target_entity_id")))
    rows = rows.withColumn("self_loop", F.col("changed") & (F.col("new_source") == F.col("new_target")))
    keys = ["new_source", "new_target", "predicate", *[c for c in ("dataset_id", "generation") if c in relations.columns]]
    order = ["changed", *[c for c in ("created_at", "created_rank") if c in relations.columns], "relation_id"]
    groups = rows.where("not self_loop")
    w = Window.partitionBy(*keys)
    groups = groups.select(
        "*", F.row_number().over(w.orderBy(*order)).alias("_n"), F.max("changed").over(w).alias("_any"), F.count("*").over(w).alias("_size"), F.first("relation_id").over(w.orderBy(*order)).alias("survivor_id"),
        *(F.max(c).over(w).alias(f"_top_{c}") for c in ("confidence", "importance_weight") if c in relations.columns),
    )
    touched = F.col("_any") & (F.col("_size") > 1)
    for c in ("confidence", "importance_weight"):
        if c in relations.columns:
            groups = groups.withColumn(c, F.when(touched & (F.col("_n") == 1), F.col(f"_top_{c}")).otherwise(F.col(c)))
    outcome = F.when(touched & (F.col("_n") > 1), "merged").when(touched, "survivor").when(F.col("changed"), "rewired").otherwise("kept")
    groups = groups.withColumn("outcome", outcome).withColumn("survivor_id", F.when(F.col("outcome") == "merged", F.col("survivor_id")))
    loops = rows.where("self_loop").withColumn("outcome", F.lit("self_loop")).withColumn("survivor_id", F.lit(None).cast(relations.schema["relation_id"].dataType))
    cols = [c for c in relations.columns if c not in ("source_entity_id", "target_entity_id")]
    final = lambda d: d.select(*cols, F.col("new_source").alias("source_entity_id"), F.col("new_target").alias("target_entity_id"), "outcome", "survivor_id", "changed")
    return final(groups).unionByName(final(loops))


def copied_evidence(evidence: DataFrame, moved: DataFrame) -> DataFrame:
    """Evidence of merged relations that their survivor lacks, once for each chunk, from the first loser that has it."""
    losers = moved.where("outcome = 'merged'").select("relation_id", "survivor_id")
    order = ["relation_id"]
    rows = evidence.join(losers, "relation_id")
    rows = rows.join(evidence.select(F.col("relation_id").alias("survivor_id"), "chunk_id"), ["survivor_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("survivor_id", "chunk_id").orderBy(*order)
    rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.select(F.col("survivor_id").alias("relation_id"), *(c for c in evidence.columns if c != "relation_id"))

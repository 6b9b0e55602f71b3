"""Property graph as vertex and edge tables: neighbourhoods, traversal, paths, scores.

Edges are (relation_id, source_entity_id, target_entity_id, ...). Traversals
keep a frontier and a visited set and join edges once a hop; every hop is a
table in the checkpoint folder, so lineage stays short and a lost executor
costs one hop. Hubs: a hop's output is bounded by the visited entities, not by
the paths that lead to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rounding import round4
from ..session import scratch

MOST_SUBGRAPH_DEPTH, MOST_PATH_DEPTH, MOST_NODES, MOST_RELATIONS = 3, 4, 100, 200


def kept(df: DataFrame) -> DataFrame:
    scratch(df.sparkSession)
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other, relation_id) in both directions; self-loops once."""
    a, b = F.col("source_entity_id"), F.col("target_entity_id")
    way = lambda x, y: F.struct(x.alias("node"), y.alias("other"))
    # One pass over the edges: a union would compute them twice.
    return edges.select(F.explode(F.when(a != b, F.array(way(a, b), way(b, a))).otherwise(F.array(way(a, b)))).alias("w"), "relation_id").select("w.node", "w.other", "relation_id")


def one_hop(seeds: DataFrame, mentions: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(chunk_id, seed_entity_id, neighbor_entity_id?, relation_id?) around seed chunks.

    Seeds without relations stay with nulls. A limit cuts in the order of seed
    rank, entity and relation. ``seeds``: chunk_id and optionally rank.
    """
    seed = seeds.select("chunk_id", *(["rank"] if "rank" in seeds.columns else []))
    met = mentions.select("chunk_id", F.col("entity_id").alias("seed_entity_id")).distinct().join(seed, "chunk_id")
    around = undirected(edges).select(F.col("node").alias("seed_entity_id"), F.col("other").alias("neighbor_entity_id"), "relation_id")
    rows = met.join(around, "seed_entity_id", "left")
    order = [*(["rank"] if "rank" in seed.columns else []), "chunk_id", "seed_entity_id", F.asc_nulls_first("relation_id")]
    cols = ["chunk_id", "seed_entity_id", "neighbor_entity_id", "relation_id"]
    return rows.select(*cols) if limit is None else rows.orderBy(*order).limit(limit).select(*cols)


def graph_scores(records: DataFrame, seed_scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, score) and (relation_id, score): the best seed score of the records that touch them."""
    rows = records.join(seed_scores.select("chunk_id", "score"), "chunk_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    seen = F.array("seed_entity_id", F.when(F.col("relation_id").isNotNull(), F.col("neighbor_entity_id")))
    entities = rows.select(F.explode(seen).alias("entity_id"), "score").where("entity_id is not null").groupBy("entity_id").agg(F.max("score").alias("score"))
    relations = rows.where("relation_id is not null").groupBy("relation_id").agg(F.max("score").alias("score"))
    return entities, relations


def scores_around(seed_scores: DataFrame, mentions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D06 of all records of ``one_hop`` around ``seed_scores(chunk_id, score)``, without making them.

    A record passes the score of its chunk to its seed entity, its neighbour and
    its relation, so each entity's best chunk is enough: a row an entity goes
    over the edges, not a row a chunk that mentions it.
    """
    own = mentions.select("chunk_id", "entity_id").join(seed_scores.select("chunk_id", F.coalesce("score", F.lit(0.0)).alias("score")), "chunk_id").groupBy("entity_id").agg(F.max("score").alias("score"))
    near = undirected(edges).join(own.withColumnRenamed("entity_id", "node"), "node")
    passed = near.where("relation_id is not null").select(F.col("other").alias("entity_id"), "score")
    entities = own.unionByName(passed).where("entity_id is not null").groupBy("entity_id").agg(F.max("score").alias("score"))
    relations = near.where("relation_id is not null").groupBy("relation_id").agg(F.max("score").alias("score"))
    return entities, relations


def scores_from_relations(relations: DataFrame) -> DataFrame:
    """Best score of an entity's relations, for entities without one of their own."""
    ends = relations.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id"), "score")
    return ends.groupBy("entity_id").agg(F.max("score").alias("score"))


def candidate_entities(entity_scores: DataFrame, relations: DataFrame) -> DataFrame:
    """Scored entities and the ends of the relations kept."""
    ends = relations.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id"))
    return entity_scores.select("entity_id").union(ends).distinct()


def by_score(df: DataFrame, id_col: str) -> DataFrame:
    """F06."""
    return df.orderBy(F.desc("score"), F.col(id_col).cast("string"))


def relations_among(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges with both ends among the nodes."""
    n = nodes.select("entity_id").distinct()
    rows = edges.join(n.select(F.col("entity_id").alias("source_entity_id")), "source_entity_id", "left_semi").join(n.select(F.col("entity_id").alias("target_entity_id")), "target_entity_id", "left_semi")
    rows = rows.select("relation_id", "source_entity_id", "target_entity_id").distinct()
    return rows if limit is None else rows.orderBy("relation_id").limit(limit)


def subgraph_nodes(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(entity_id, hop) of everything within ``depth`` hops of the roots, the roots at hop 0."""
    if not 1 <= depth <= MOST_SUBGRAPH_DEPTH:
        raise ValueError(f"depth must be between 1 and {MOST_SUBGRAPH_DEPTH}")
    both = undirected(edges).select("node", "other").where("node <> other")
    seen = roots.select("entity_id", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("entity_id").alias("node")), "node", "left_semi").select(F.col("other").alias("entity_id")).distinct()
        frontier = kept(reached.join(seen, "entity_id", "left_anti").select("entity_id", F.lit(hop).alias("hop")))
        seen = seen.unionByName(frontier)
    return seen


def capped_nodes(nodes: DataFrame, cap: int = MOST_NODES) -> tuple[DataFrame, Column]:
    """the first ``cap`` nodes by (hop, id), and whether more were there, as a column over that result's count."""
    return nodes.orderBy("hop", F.col("entity_id").cast("string")).limit(cap), F.lit(nodes.limit(cap + 1).count() > cap)


def subgraph(edges: DataFrame, entities: DataFrame, root, depth: int, cap: int = MOST_NODES, around=None) -> dict[str, DataFrame]:
    """Root check, traversal, cap, nodes and edges among them, truncated. ``around``: the stored adjacency of the edges; then they are not read to traverse."""
    start = entities.where(F.col("entity_id") == F.lit(root))
    if start.isEmpty():
        raise LookupError("entity not found")
    nodes, cut = capped_nodes(subgraph_nodes(edges, start, depth) if around is None else around.subgraph_nodes(start, depth), cap)
    live = entities.join(nodes.select("entity_id", "hop"), "entity_id")
    return {"entities": live.orderBy("hop", "entity_id"), "relations": relations_among(edges, live), "truncated": live.sparkSession.range(1).select(cut.alias("truncated"))}


def shortest_path(edges: DataFrame, start, end, most: int = MOST_PATH_DEPTH) -> DataFrame:
    """One row (length, nodes, relations) of the shortest undirected path, by node ids the smallest; no row if none within ``most``.

    Breadth first from the start; every reached node keeps its smallest path.
    """
    if not 1 <= most <= MOST_PATH_DEPTH:
        raise ValueError(f"depth must be between 1 and {MOST_PATH_DEPTH}")
    spark = edges.sparkSession
    both = undirected(edges).where("node <> other")
    first = spark.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("nodes"), F.array().cast("array<string>").alias("relations"))
    if start == end:
        return first.select(F.lit(0).alias("length"), "nodes", "relations")
    seen, frontier = first.select("node"), first
    for hop in range(1, most + 1):
        # The edges at the frontier only; paths to one node with equal nodes differ in their last relation alone.
        step = frontier.join(both, "node").select(F.col("other").alias("node"), F.struct(F.array_append("nodes", F.col("other")).alias("nodes"), "relation_id", "relations").alias("p"))
        step = step.groupBy("node").agg(F.min("p").alias("p")).join(seen, "node", "left_anti")
        step = step.select("node", "p.nodes", F.array_append("p.relations", F.col("p.relation_id").cast("string")).alias("relations"))
        frontier = kept(step)
        hit = frontier.where(F.col("node") == F.lit(end))
        if not hit.isEmpty():
            return hit.select(F.lit(hop).alias("length"), "nodes", "relations")
        seen = seen.union(frontier.select("node"))
    return first.where("false").select(F.lit(0).alias("length"), "nodes", "relations")


def path(edges: DataFrame, entities: DataFrame, start, end, most: int = MOST_PATH_DEPTH, around=None) -> DataFrame:
    """(found, length, nodes, relations). Both ends must exist; a path over a node that is not current is not found. ``around`` as for ``subgraph``."""
    live = entities.where(F.col("entity_id").isin(start, end)).select("entity_id").distinct().count()
    if live != len({start, end}):
        raise LookupError("entity not found")
    found = shortest_path(edges, start, end, most) if around is None else around.shortest_path(start, end, most)
    stops = found.select("length", "nodes", "relations", F.explode("nodes").alias("entity_id"))
    known = stops.join(entities.select("entity_id").distinct(), "entity_id").groupBy("length", "nodes", "relations").count().where("count = size(nodes)")
    one = found.sparkSession.range(1).select(F.lit(1).alias("one"))
    return one.join(known.withColumn("one", F.lit(1)), "one", "left").select(F.col("length").isNotNull().alias("found"), "length", "nodes", "relations")


def graph_schema(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, value): entity types, predicates, and the fixed labels and edge kinds."""
    fixed = entities.sparkSession.createDataFrame([("node_label", "Entity"), ("node_label", "Chunk"), ("relationship_type", "RELATES_TO"), ("relationship_type", "MENTIONED_IN"), ("relationship_type", "NEXT")], "kind string, value string")
    types = entities.select(F.lit("entity_type").alias("kind"), F.col("entity_type").alias("value")).distinct()
    predicates = relations.select(F.lit("predicate").alias("kind"), F.col("predicate").alias("value")).distinct()
    return types.union(predicates).union(fixed).orderBy("kind", "value")


def next_edges(chunks: DataFrame) -> DataFrame:
    """(chunk_id, next_chunk_id) for ordinals that follow without a gap in one document and generation."""
    w = Window.partitionBy("dataset_id", "document_id", "generation").orderBy("ordinal", "chunk_id")
    rows = chunks.select("dataset_id", "chunk_id", "ordinal", F.lead("chunk_id").over(w).alias("next_chunk_id"), F.lead("ordinal").over(w).alias("next_ordinal"))
    return rows.where("next_ordinal = ordinal + 1").select("dataset_id", "chunk_id", "next_chunk_id")


def degree_centrality(edges: DataFrame, entities: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Degree over edges that are no self-loops, divided by the largest degree (of each key group), four decimals.

    With ``entities`` those without an edge are there with 0, and ends outside it do not count.
    """
    ends = edges.where("source_entity_id <> target_entity_id").select(*keys, F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id"))
    degree = ends.groupBy(*keys, "entity_id").agg(F.count("*").alias("degree"))
    if entities is not None:
        degree = entities.select(*keys, "entity_id").join(degree, [*keys, "entity_id"], "left").na.fill(0, ["degree"])
    if keys:
        rows = degree.join(degree.groupBy(*keys).agg(F.max("degree").alias("_top")), list(keys))
    else:
        rows = degree.withColumn("_top", degree.agg(F.max("degree")).scalar())
    return rows.select(*keys, "entity_id", "degree", F.when(F.col("_top") > 0, round4(F.col("degree") / F.col("_top"))).otherwise(F.lit(0.0)).alias("centrality"))


def relation_centrality(edges: DataFrame, centrality: DataFrame) -> DataFrame:
    """The mean of the ends' centralities, four decimals."""
    c = centrality.select("entity_id", "centrality")
    rows = edges.join(c.select(F.col("entity_id").alias("source_entity_id"), F.col("centrality").alias("_a")), "source_entity_id", "left")
    rows = rows.join(c.select(F.col("entity_id").alias("target_entity_id"), F.col("centrality").alias("_b")), "target_entity_id", "left")
    return rows.select("relation_id", round4((F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / 2).alias("centrality"))


def without_evidence(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Relations that no visible evidence supports."""
    return relations.join(evidence.select("relation_id").distinct(), "relation_id", "left_anti")

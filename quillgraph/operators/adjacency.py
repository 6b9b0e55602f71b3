"""Adjacency kept in storage order, so that a hop moves the frontier and not the edges.

Each edge is stored at both of its ends, a row a pair of nodes with its least
relation, in ``BUCKETS`` files by hash of the node and sorted by it. A join
with a frontier dealt by the same hash needs no exchange of the edges; a
frontier counted to be small is broadcast, and then the nodes meet the scan.
Paths are searched from both ends, the smaller frontier first, until the two
meet, so each side goes half of the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import MOST_PATH_DEPTH, MOST_SUBGRAPH_DEPTH, kept, undirected

BUCKETS = 32
SMALL = 20_000  # nodes of a frontier that is broadcast


def pairs(edges: DataFrame) -> DataFrame:
    """(node, other, relation_id, forward): one row for each pair of neighbours, seen from both; ``forward``: some relation leads from ``node`` to ``other``."""
    # One row for both directions of a pair is grouped and then seen from both ends, so the edges are read and dealt once.
    s, t = F.col("source_entity_id"), F.col("target_entity_id")
    both = edges.where(s != t).groupBy(F.least(s, t).alias("a"), F.greatest(s, t).alias("b")).agg(
        F.min(F.col("relation_id").cast("string")).alias("relation_id"), F.max(s < t).alias("up"), F.max(s > t).alias("down"))
    way = lambda x, y, forward: F.struct(F.col(x).alias("node"), F.col(y).alias("other"), F.col(forward).alias("forward"))
    return both.select(F.explode(F.array(way("a", "b", "up"), way("b", "a", "down"))).alias("w"), "relation_id").select("w.node", "w.other", "relation_id", "w.forward")


@dataclass
class Adjacency:
    """Neighbour pairs, stored or not: ``rows`` as ``pairs`` gives them."""

    spark: SparkSession
    rows: DataFrame

    @classmethod
    def build(cls, edges: DataFrame, path: str, *, buckets: int = BUCKETS) -> None:
        """Write the pairs as a bucketed table at ``path``."""
        name = f"quillgraph_building_{abs(hash(path))}"
        out = pairs(edges).repartition(buckets, "node")
        out.write.format("parquet").option("path", path).bucketBy(buckets, "node").sortBy("node").mode("overwrite").saveAsTable(name)
        edges.sparkSession.sql(f"DROP TABLE {name}")  # its files stay

    @classmethod
    def open(cls, spark: SparkSession, path: str, *, buckets: int = BUCKETS) -> Adjacency:
        """The pairs stored at ``path``, known to the session as a bucketed table."""
        name = "quillgraph_adjacency_" + path.rsplit("-", 1)[-1].replace("/", "_").replace(".", "_")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({kinds}) USING parquet CLUSTERED BY (node) SORTED BY (node) INTO {buckets} BUCKETS LOCATION '{path}'")
        return cls(spark, spark.table(name))

    def at(self, frontier: DataFrame, n: int) -> DataFrame:
        """The pairs at the ``n`` nodes of ``frontier``, with its columns."""
        return self.rows.join(F.broadcast(frontier) if n <= SMALL else frontier, "node")

    def subgraph_nodes(self, roots: DataFrame, depth: int) -> DataFrame:
        """(entity_id, hop) of everything within ``depth`` hops of the roots, the roots at hop 0."""
        if not 1 <= depth <= MOST_SUBGRAPH_DEPTH:
            raise ValueError(f"depth must be between 1 and {MOST_SUBGRAPH_DEPTH}")
        frontier = kept(roots.select(F.col("entity_id").alias("node"), F.lit(0).alias("hop")).distinct())
        seen = frontier
        for hop in range(1, depth + 1):
            n = frontier.count()
            if not n:
                break
            reached = self.at(frontier.select("node"), n).select(F.col("other").alias("node")).distinct()
            frontier = kept(reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop")))
            seen = seen.unionByName(frontier)
        return seen.select(F.col("node").alias("entity_id"), "hop")

    def shortest_path(self, start, end, most: int = MOST_PATH_DEPTH) -> DataFrame:
        """One row (length, nodes, relations) of the shortest undirected path, by node ids the smallest; no row if none within ``most``.

        From either end every reached node keeps its smallest way to that end.
        All ways to a node are equally long, so the smallest of both sides
        together are the smallest path over that node.
        """
        if not 1 <= most <= MOST_PATH_DEPTH:
            raise ValueError(f"depth must be between 1 and {MOST_PATH_DEPTH}")
        first = lambda x: self.spark.range(1).select(F.lit(x).alias("node"), F.array(F.lit(x)).alias("nodes"), F.array().cast("array<string>").alias("relations"))
        if start == end:
            return first(start).select(F.lit(0).alias("length"), "nodes", "relations")
        sides = [first(start), first(end)]
        seen, counts = [sides[0].select("node"), sides[1].select("node")], [1, 1]
        for hop in range(1, most + 1):
            k = 0 if counts[0] <= counts[1] else 1
            step = self.at(sides[k], counts[k]).select(F.col("other").alias("node"), F.struct("nodes", "relation_id", "relations").alias("p"))
            step = step.groupBy("node").agg(F.min("p").alias("p")).join(seen[k], "node", "left_anti")
            one, edge = F.array("node"), F.array("p.relation_id")
            way = [F.concat("p.nodes", one), F.concat("p.relations", edge)] if k == 0 else [F.concat(one, "p.nodes"), F.concat(edge, "p.relations")]
            sides[k] = kept(step.select("node", way[0].alias("nodes"), way[1].alias("relations")))
            counts[k] = sides[k].count()
            there = sides[1].select("node", F.col("nodes").alias("n1"), F.col("relations").alias("r1"))
            met = sides[0].join(there, "node").select(F.concat("nodes", F.slice("n1", 2, most + 1)).alias("nodes"), F.concat("relations", "r1").alias("relations"))
            hit = kept(met.agg(F.min(F.struct("nodes", "relations")).alias("p")).where("p is not null").select(F.lit(hop).alias("length"), "p.nodes", "p.relations"))
            if not hit.isEmpty():
                return hit
            if not counts[k]:
                break
            seen[k] = seen[k].union(sides[k].select("node"))
        return first(start).where("false").select(F.lit(0).alias("length"), "nodes", "relations")

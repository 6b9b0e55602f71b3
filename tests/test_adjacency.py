"""Stored adjacency: paths and neighbourhoods against breadth-first search in Python, and plans without an exchange of the edges."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import adjacency, graph

EDGES = "relation_id string, source_entity_id string, target_entity_id string"


def model(edges, start, end, most):
    near = {}
    for r, a, b in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {}).setdefault(y, []).append(r)
    if start == end:
        return 0, [start], []
    ways, seen = [[start]], {start}
    for hop in range(1, most + 1):
        ways = [[*w, y] for w in ways for y in near.get(w[-1], ()) if y not in seen]
        hit = [w for w in ways if w[-1] == end]
        if hit:
            nodes = min(hit)
            return hop, nodes, [min(near[x][y]) for x, y in itertools.pairwise(nodes)]
        seen |= {w[-1] for w in ways}
    return None


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(8)
    edges = [(f"r{k:04}", f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for k in range(80)]
    df = spark.createDataFrame(edges, EDGES)
    path = str(tmp_path_factory.mktemp("adjacency") / "pairs-x1")
    adjacency.Adjacency.build(df, path, buckets=4)
    return edges, df, adjacency.Adjacency.open(spark, path, buckets=4)


@pytest.mark.parametrize("small", [20_000, 0])
def test_paths(stored, monkeypatch, small):
    monkeypatch.setattr(adjacency, "SMALL", small)
    edges, df, near = stored
    rng = random.Random(small)
    for _ in range(6):
        a, b = (f"n{rng.randrange(62):02}" for _ in range(2))
        got = near.shortest_path(a, b).collect()
        want = model(edges, a, b, 4)
        assert [(r.length, r.nodes, r.relations) for r in got] == ([want] if want else [])


def test_neighbourhoods(spark, stored):
    _, df, near = stored
    roots = spark.createDataFrame([("n01",), ("n02",), ("nowhere",)], "entity_id string")
    for depth in (1, 2, 3):
        got = {r.entity_id: r.hop for r in near.subgraph_nodes(roots, depth).collect()}
        assert got == {r.entity_id: r.hop for r in graph.subgraph_nodes(df, roots, depth).collect()}
    with pytest.raises(ValueError):
        near.subgraph_nodes(roots, 9)


def test_edges_are_not_exchanged(spark, stored):
    _, _, near = stored
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = near.at(spark.createDataFrame([("n01",)], "node string"), 10**9)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scan = plan.index("FileScan")
    above = [line for line in plan[:scan].splitlines() if "Exchange" in line and "+- Exchange" in line or ":- Exchange" in line]
    assert "Bucketed: true" in plan and not above, plan


def test_edges_are_read_once_for_both_directions(spark):
    df = spark.createDataFrame([("r2", "a", "b"), ("r1", "b", "a"), ("r3", "c", "b"), ("r4", "c", "c"), ("r5", "c", None)], EDGES)
    got = sorted(tuple(r) for r in adjacency.pairs(df).select("node", "other", "relation_id", "forward").collect())
    assert got == [("a", "b", "r1", True), ("b", "a", "r1", True), ("b", "c", "r3", False), ("c", "b", "r3", True)]
    plan = adjacency.pairs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_capped_subgraph_and_path_from_stored_pairs(spark, stored):
    """F16: with the stored pairs the edges are not read to traverse; the same nodes and path come out."""
    edges, df, around = stored
    ents = around.rows.select(F.col("node").alias("entity_id")).distinct()
    root = edges[0][1]
    plain, kept = graph.subgraph(df, ents, root, 2, cap=9), graph.subgraph(df.where("false"), ents, root, 2, cap=9, around=around)
    for part in ("entities", "truncated"):
        assert plain[part].collect() == kept[part].collect()
    end = plain["entities"].collect()[-1].entity_id
    cols = ["found", "length", "nodes"]
    assert graph.path(df, ents, root, end).select(*cols).collect() == graph.path(df.where("false"), ents, root, end, around=around).select(*cols).collect()

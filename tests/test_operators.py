"""Scope, graph, deduplication, feedback and projection on small made-up rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.operators import dedup, feedback, graph, listing, projection, scope, search


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_schema(spark):
    for name in schema.DDL:
        assert schema.schema(name).fields
    bad = spark.createDataFrame([("r", "c", "q", 1.5), ("r", "d", "q", 0.5)], "relation_id string, chunk_id string, quote string, confidence float")
    assert rows(schema.violations(bad, "relation_evidence"), "chunk_id") == [("c",)]
    fb = spark.createDataFrame([("a", 2), ("b", 1)], "id string, score int").withColumn("target_type", F.lit("answer"))
    assert rows(schema.violations(fb, "feedback"), "id") == [("a",)]
    dup = spark.createDataFrame([("d", "k", True), ("d", "k", True), ("d", "k", False)], "dataset_id string, canonical_key string, is_active boolean")
    assert schema.duplicates(dup, "entities").first()["count"] == 2


@pytest.mark.parametrize("wanted,hit", [({"a": 1}, True), ({"a": "1"}, False), ({"b": {"c": "x"}}, True), ({"b": {"c": "y"}}, False), ({"l": [2]}, True), ({"l": [4]}, False), ({"n": None}, True), ({"t": True}, True), ({}, True), ({"zz": 1}, False)])
def test_metadata_containment(spark, wanted, hit):
    m = json.dumps({"a": 1, "b": {"c": "x", "d": 2}, "l": [1, 2, 3], "n": None, "t": True})
    df = spark.createDataFrame([(m,), (None,), ("bad",)], "m string")
    assert df.where(scope.contains_metadata(F.col("m"), wanted)).where("m is not null and m <> 'bad'").count() == int(hit)
    assert df.where("m <> 'bad'").where(scope.contains_json(F.col("m"), wanted)).count() == int(hit)
    assert df.where(scope.contains_json(F.col("m"), wanted)).where("m is null").count() == 0 if hit is None else True


def test_unknown_dataset_raises(spark):
    sets = spark.createDataFrame([("1", "a", "active", 1), ("2", "b", "deleting", 1)], "dataset_id string, slug string, status string, active_generation int")
    assert rows(scope.resolve_datasets(spark, sets, ["a", "a"]), "dataset_id") == [("1",)]
    with pytest.raises(Exception, match="dataset not found: b"):
        scope.resolve_datasets(spark, sets, ["b"]).collect()


def test_current_relations_need_both_ends(spark):
    sets = spark.createDataFrame([("d", "d", "active", 2)], "dataset_id string, slug string, status string, active_generation int")
    ents = spark.createDataFrame([("a", "d", 2, True), ("b", "d", 2, True), ("c", "d", 1, True), ("x", "d", 2, False)], "entity_id string, dataset_id string, generation int, is_active boolean")
    rel = spark.createDataFrame([("1", "d", 2, True, "a", "b"), ("2", "d", 2, True, "a", "c"), ("3", "d", 2, True, "x", "b"), ("4", "d", 2, False, "a", "b")], "relation_id string, dataset_id string, generation int, is_active boolean, source_entity_id string, target_entity_id string")
    assert rows(scope.active_relations(rel, ents, sets), "relation_id") == [("1",)]
    assert listing.dataset_stats(sets, ents.select("dataset_id", F.lit("active").alias("status"), F.lit("s").alias("source_id")), ents.select("dataset_id", "generation", "is_active", F.lit("s").alias("document_id"), F.lit("s").alias("source_id")), ents.select("dataset_id", "generation", "is_active", F.lit("s").alias("document_id"), F.lit("s").alias("source_id")), ents, rel).first()["relations_active_current_generation"] == 1


def test_fusion_golden(spark):
    a = spark.createDataFrame([("A", 1), ("B", 2)], "chunk_id string, rank int")
    b = spark.createDataFrame([("B", 1), ("C", 2)], "chunk_id string, rank int")
    got = search.fuse(a, b).collect()
    assert [r.chunk_id for r in got] == ["B", "A", "C"] and (got[0].vector_rank, got[0].lexical_rank) == (2, 1)
    with pytest.raises(ValueError):
        search.checked_top_k(101)
    assert search.checked_top_k(None) == 12


def test_references_prefer_hits(spark):
    hits = spark.createDataFrame([("c1", 0.5)], "chunk_id string, score double").withColumns({c: F.lit("x") for c in ("source_id", "source_name", "document_id", "text")}).withColumns({c: F.lit(0) for c in ("ordinal", "start_char", "end_char")})
    ev = hits.drop("score").withColumn("quote", F.lit("q")).withColumn("relation_id", F.lit("r"))
    ev = ev.union(ev.withColumn("chunk_id", F.lit("c2")))
    scores = spark.createDataFrame([("r", 0.25)], "relation_id string, relation_score double")
    assert rows(search.references(hits, ev, scores), "chunk_id", "score") == [("c1", 0.5), ("c2", 0.25)]


EDGES = [("1", "a", "b"), ("2", "b", "c"), ("3", "c", "d"), ("4", "a", "e"), ("5", "e", "d"), ("6", "a", "a")]


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(EDGES, "relation_id string, source_entity_id string, target_entity_id string")


def test_traversal(spark, edges):
    root = spark.createDataFrame([("a",)], "entity_id string")
    assert rows(graph.subgraph_nodes(edges, root, 1), "entity_id", "hop") == [("a", 0), ("b", 1), ("e", 1)]
    assert len(rows(graph.subgraph_nodes(edges, root, 3), "entity_id")) == 5
    p = graph.shortest_path(edges, "a", "d").first()
    assert p["length"] == 2 and p["nodes"] == ["a", "e", "d"] and p["relations"] == ["4", "5"]
    assert graph.shortest_path(edges, "a", "a").first()["length"] == 0
    assert graph.shortest_path(edges, "a", "zz").count() == 0
    ents = spark.createDataFrame([(x,) for x in "abcd"], "entity_id string")
    assert graph.path(edges, ents, "a", "d").first()["found"] is False  # e is not current
    with pytest.raises(LookupError):
        graph.path(edges, ents, "a", "q")
    with pytest.raises(ValueError):
        graph.subgraph_nodes(edges, root, 4)
    got = graph.subgraph(edges, ents, "a", 2, cap=2)
    assert got["truncated"].first()["truncated"] is True
    assert graph.relations_among(edges, ents).count() == 4


def test_scores_do_not_depend_on_order(spark, edges):
    seeds = spark.createDataFrame([("c1", 0.9), ("c2", 0.4)], "chunk_id string, score double")
    men = spark.createDataFrame([("b", "c1"), ("d", "c2"), ("zz", "c2")], "entity_id string, chunk_id string")
    rec = graph.one_hop(seeds, men, edges)
    e, r = graph.graph_scores(rec, seeds)
    assert dict(rows(e, "entity_id", "score")) == {"a": 0.9, "b": 0.9, "c": 0.9, "d": 0.4, "e": 0.4, "zz": 0.4}
    e2, _ = graph.graph_scores(rec.orderBy(F.desc("relation_id")), seeds)
    assert rows(e, "entity_id", "score") == rows(e2, "entity_id", "score")
    assert dict(rows(r, "relation_id", "score")) == {"1": 0.9, "2": 0.9, "3": 0.4, "5": 0.4}


def test_centrality(spark, edges):
    got = dict(rows(graph.degree_centrality(edges), "entity_id", "centrality"))
    assert got == {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0, "e": 1.0}
    ents = spark.createDataFrame([("a",), ("zz",)], "entity_id string")
    assert dict(rows(graph.degree_centrality(edges, ents), "entity_id", "centrality")) == {"a": 1.0, "zz": 0.0}
    loops = edges.where("relation_id = '6'")
    assert rows(graph.degree_centrality(loops, ents), "centrality") == [(0.0,), (0.0,)]


def greedy(order, pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    gone, out = set(), {}
    for s in order:
        if s in gone:
            continue
        for n in near.get(s, ()):
            if n not in gone and n != s and n not in out and order.index(n) > order.index(s):
                out[n] = s
                gone.add(n)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge_plan_is_the_greedy_one(spark, seed):
    rng = random.Random(seed)
    ids = [f"e{i:02d}" for i in range(30)]
    pairs = sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(35)})
    rank = {x: rng.random() for x in ids}
    ents = spark.createDataFrame([(x, rank[x]) for x in ids], "entity_id string, created_rank double")
    plan = dedup.merge_plan(ents, spark.createDataFrame(pairs, "entity_id string, candidate_id string"))
    assert dict(rows(plan, "entity_id", "survivor_id")) == greedy(sorted(ids, key=rank.get), pairs)


@pytest.mark.parametrize("tile", [3, 1024])
def test_candidates_in_tiles_equal_all_pairs(spark, monkeypatch, tile):
    """One large type, null and equal vectors, other lengths, a null dataset: every pair once, whatever the tiles."""
    monkeypatch.setattr(dedup, "TILE", tile)
    rng = random.Random(3)
    data = [(f"e{i}", "a" if i % 4 else None, "Org" if i % 5 else " org", [rng.choice((0.0, 1.0, 2.0)) for _ in range(3 if i % 7 else 2)]) for i in range(40)]
    data += [("n1", "a", "org", None), ("n2", "a", "org", [1.0, None, 1.0]), ("n3", "a", "org", [1.0, float("nan"), 1.0]), ("n4", "a", None, [1.0, 1.0, 1.0]), ("n5", "a", "org", [])]
    ents = spark.createDataFrame(data, "entity_id string, dataset_id string, entity_type string, embedding array<float>")
    want = set()
    for x in data[:40]:
        for y in data[:40]:
            if x[0] < y[0] and x[1] == y[1] and len(x[3]) == len(y[3]) and any(x[3]) and any(y[3]):
                dot = sum(p * q for p, q in zip(x[3], y[3], strict=True))
                if dot / (sum(p * p for p in x[3]) * sum(q * q for q in y[3])) ** 0.5 >= 0.79:  # no pair of these is at 0.79
                    want.add((x[0], y[0]))
    got = rows(dedup.duplicate_candidates(ents, 0.79), "entity_id", "candidate_id")
    assert len(got) == len(set(got)) and set(got) == want and want
    assert dedup.duplicate_candidates(ents.where("false")).count() == 0


def test_merges_are_not_transitive(spark):
    v = [[c, (1 - c * c) ** 0.5] for c in (1.0, 0.98, 0.92)]
    ents = spark.createDataFrame([(str(i), " Org", x, i) for i, x in enumerate(v)], "entity_id string, entity_type string, embedding array<float>, created_rank int").withColumn("dataset_id", F.lit("d"))
    found = dedup.duplicate_candidates(ents, 0.90)
    assert found.count() == 3
    assert rows(dedup.merge_plan(ents, found.where("similarity >= 0.95")), "entity_id", "survivor_id") == [("1", "0")]


def test_apply_merges(spark):
    ents = spark.createDataFrame([("a", "Acme", ["ACME Inc", "acme"], True, 1), ("b", "Acme Ltd", ["acme inc", "AL"], True, 2)], "entity_id string, name string, aliases array<string>, is_active boolean, created_rank int")
    men = spark.createDataFrame([("b", "c1"), ("a", "c2")], "entity_id string, chunk_id string")
    plan = spark.createDataFrame([("b", "a")], "entity_id string, survivor_id string")
    e, m = dedup.apply_merges(ents, men, plan)
    got = {r.entity_id: r for r in e.collect()}
    assert got["a"].aliases == ["ACME Inc", "Acme Ltd", "AL"] and got["a"].is_active and not got["b"].is_active
    assert rows(m, "entity_id", "chunk_id") == [("a", "c1"), ("a", "c2")]


def test_rewiring(spark):
    rel = spark.createDataFrame([
        ("r1", "a", "x", "p", 0.5, 0.2), ("r2", "b", "x", "p", 0.9, 0.1), ("r3", "a", "b", "q", 0.5, 0.5), ("r4", "b", "y", "p", 0.5, 0.5), ("r5", "y", "y", "p", 0.5, 0.5),
    ], "relation_id string, source_entity_id string, target_entity_id string, predicate string, confidence double, importance_weight double")
    plan = spark.createDataFrame([("b", "a")], "entity_id string, survivor_id string")
    got = {r.relation_id: r for r in dedup.rewired(rel, plan).collect()}
    assert {k: v.outcome for k, v in got.items()} == {"r1": "survivor", "r2": "merged", "r3": "self_loop", "r4": "rewired", "r5": "kept"}
    assert (got["r1"].confidence, got["r1"].importance_weight) == (0.9, 0.2) and got["r4"].source_entity_id == "a"
    ev = spark.createDataFrame([("r1", "c1", 0.5), ("r2", "c1", 0.5), ("r2", "c2", 0.7)], "relation_id string, chunk_id string, confidence double")
    assert rows(dedup.copied_evidence(ev, dedup.rewired(rel, plan)), "relation_id", "chunk_id", "confidence") == [("r1", "c2", 0.7)]


def test_feedback(spark):
    refs = json.dumps({"items": [{"source_id": "s", "document_id": "d", "chunk_id": c} for c in ("c1", "c2")]})
    q = spark.createDataFrame([("q", ["d"], refs)], "query_id string, dataset_ids array<string>, references string")
    fb = spark.createDataFrame([("f1", "q", "answer", None, 1, 1), ("f2", "q", "reference", "c2", -1, 2), ("f3", "q", "reference", "c9", 1, 3)], "feedback_id string, query_id string, target_type string, target_id string, score int, created_at int").withColumn("applied_at", F.lit(None).cast("timestamp"))
    t = feedback.target_chunks(feedback.unapplied(fb, q, "d"))
    assert rows(t, "feedback_id", "chunk_id") == [("f1", "c1"), ("f1", "c2"), ("f2", "c2"), ("f3", "c9")]
    hit = t.where("chunk_id <> 'c9'").withColumn("entity_id", F.lit("e")).select("feedback_id", "created_at", "score", "entity_id").distinct()
    items = spark.createDataFrame([("e", 0.5, None, None), ("z", 0.5, None, None)], "entity_id string, importance_weight double, feedback_weight double, centrality_weight double")
    assert rows(feedback.weights_after(items, hit, "entity_id"), "entity_id", "importance_weight") == [("e", 0.495)]
    marked = spark.createDataFrame([("e", 0.75, 0.5, 1.0)], "entity_id string, importance_weight double, feedback_weight double, centrality_weight double")
    assert rows(feedback.weights_after(marked, hit, "entity_id"), "feedback_weight", "importance_weight") == [(0.495, 0.7475)]
    assert dict(rows(feedback.outcome(fb, hit), "feedback_id", "outcome")) == {"f1": "applied", "f2": "applied", "f3": "skipped"}


def test_projection(spark):
    cmd = spark.createDataFrame([
        (1, "d", "entity", "e1", "upsert", None, None, "{}"), (2, "d", "chunk", "c1", "upsert", None, None, "{}"), (3, "d", "entity_mention", "m1", "upsert", "e1", "c1", None), (4, "d", "entity_mention", "m2", "upsert", "e9", "c1", None),
        (5, "d", "entity", "e2", "upsert", None, None, "{}"), (6, "d", "entity_mention", "m3", "upsert", "e2", "c1", None), (7, "d", "entity", "e2", "delete", None, None, None), (8, "d", "entity", "e3", "upsert", None, None, None), (9, "d", "odd", "x", "upsert", None, None, "{}"),
    ], "id long, dataset_id string, aggregate_type string, aggregate_id string, operation string, source_id string, target_id string, payload string")
    good, bad = projection.split_invalid(cmd)
    assert rows(bad, "id") == [(8,), (9,)]
    nodes, links, missing = projection.applied(projection.latest_state(good))
    assert rows(nodes, "aggregate_id") == [("c1",), ("e1",)] and rows(links, "aggregate_id") == [("m1",)] and rows(missing, "aggregate_id") == [("m2",)]
    assert projection.once(good.withColumn("aggregate_id", F.lit("z")).where("id in (1, 5)"), ["id"], last=True).first()["id"] == 5
    want = projection.identities({"entity": spark.createDataFrame([("d", "1"), ("d", None)], "dataset_id string, id string")})
    have = spark.createDataFrame([("d", "entity", "1"), ("d", "entity", "7")], "dataset_id string, kind string, id string")
    diff, state = projection.reconcile(want, have, rebuild=lambda e: e)
    assert rows(diff, "missing", "extra") == [(1, 1)] and state == "rebuilt"
    assert projection.reconcile(want, want)[1] == "in_sync"
    with pytest.raises(RuntimeError):
        projection.reconcile(want, have, rebuild=lambda e: have)
    assert projection.uniqueness(have.union(have)).count() == 2
    assert projection.wiped(have, have.select("dataset_id")).count() == 0


def test_next_edges_skip_gaps(spark):
    c = spark.createDataFrame([("d", "x", 1, o, f"c{o}") for o in (0, 1, 3, 4)], "dataset_id string, document_id string, generation int, ordinal int, chunk_id string")
    assert rows(graph.next_edges(c), "chunk_id", "next_chunk_id") == [("c0", "c1"), ("c3", "c4")]


def test_scores_around_equal_those_of_the_records(spark):
    seeds = spark.createDataFrame([("c1", 0.9), ("c2", 0.4), ("c3", None)], "chunk_id string, score double")
    men = spark.createDataFrame([("b", "c1"), ("d", "c2"), ("zz", "c2"), ("b", "c2"), ("a", "c3"), ("f", "c9"), (None, "c1")], "entity_id string, chunk_id string")
    edges = spark.createDataFrame([*EDGES, (None, "b", "n"), ("7", "d", None), ("8", "a", "b")], "relation_id string, source_entity_id string, target_entity_id string")
    for a, b in zip(graph.graph_scores(graph.one_hop(seeds, men, edges), seeds), graph.scores_around(seeds, men, edges), strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("name", ["graph_scores_all", "graph_relation_scores_all"])
def test_scores_from_all_seeds_make_no_records(spark, sf_dir, monkeypatch, name):
    from quillgraph.plans import registry

    monkeypatch.setattr(graph, "one_hop", lambda *_: pytest.fail("a row for each chunk, entity and relation"))
    assert not registry.QUERIES[name](spark, sf_dir).isEmpty()


def test_an_edge_is_turned_in_one_pass(spark, edges):
    plan = graph.undirected(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    assert len(rows(graph.undirected(edges), "node")) == 2 * len(EDGES) - 1

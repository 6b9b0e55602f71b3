"""Ingest, extraction, upkeep, forgetting and provenance as whole flows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillgraph import providers
from quillgraph.functions.scalars import valid_extraction
from quillgraph.plans import cognify, forget, improve, provenance, recall, registry, remember
from quillgraph.sources.fixtures import Fixture


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


TEXTS = [("d1", "Alpha met Beta in Paris. Beta likes Gamma.\n\nGamma wrote to Alpha."), ("d2", "Alpha lives with Delta.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, "s" + i, "set", 1, t) for i, t in TEXTS], "document_id string, source_id string, dataset_id string, generation int, normalized_text string")


def test_cognify_is_repeatable_and_merges(spark, docs):
    got = cognify.cognified(docs, most=12, overlap=0, least=2)
    ents = {r.canonical_key: r for r in got["entities"].collect()}
    assert "term:alpha" in ents and ents["term:alpha"].aliases == ["Alpha"]
    assert len(ents) == got["entities"].count()
    again = cognify.cognified(docs, most=12, overlap=0, least=2)
    for k in ("entities", "relations", "mentions"):
        key = {"entities": "entity_id", "relations": "relation_id", "mentions": "mention_id"}[k]
        assert rows(got[k], key) == rows(again[k], key)
    have = {"mentions": got["mentions"], "evidence": got["evidence"]}
    more = cognify.cognified(docs, have, most=12, overlap=0, least=2)
    assert more["mentions"].count() == 0 and more["evidence"].count() == 0
    chunks = {r.chunk_id: r.text for r in got["chunks"].collect()}
    for m in got["mentions"].collect():
        assert chunks[m.chunk_id][m.start_char : m.end_char] == m.surface_text
    kinds = {r[0] for r in got["commands"].select("aggregate_type").distinct().collect()}
    assert kinds == {"entity", "chunk", "entity_mention", "relation", "chunk_next"}
    assert got["summaries"].count() == 2 and got["rejected"].count() == 0


def test_descriptions_keep_the_first(spark):
    schema = "dataset_id string, canonical_key string, entity_id string, generation int, name string, type string, description string, aliases array<string>, confidence double"
    new = spark.createDataFrame([("d", "k", "e", 1, "N2", "t", "late", ["b", "a"], 0.9)], schema).withColumn("seen", F.struct(F.lit("x").alias("document_id"), F.lit(0).alias("ordinal"), F.lit(0).alias("at")))
    old = spark.createDataFrame([("d", "k", "e", 1, "N1", "t", " ", ["a"], 0.5)], schema)
    r = cognify.merged_entities(new, old).first()
    assert (r["name"], r.description, r.aliases, r.confidence) == ("N1", "late", ["a", "b"], 0.9)


def test_extraction_validation(spark):
    def ok(entities, relations, text="A B"):
        df = spark.createDataFrame([({"summary": "", "entities": entities, "relations": relations}, text)], f"x struct<{providers.EXTRACTION.replace('summary string', 'summary:string').replace('entities array', 'entities:array').replace('relations array', 'relations:array')}>, t string")
        return df.select(valid_extraction(F.col("x"), F.col("t")).alias("v")).first()["v"]

    e = lambda i, **k: {"local_id": i, "name": "A", "type": "t", "description": "", "aliases": ["A"], "confidence": 0.5} | k
    r = lambda **k: {"source_local_id": "1", "target_local_id": "2", "predicate": "p", "description": "", "confidence": 0.5, "evidence": "A"} | k
    assert ok([e("1"), e("2")], [r()])
    assert not ok([e("1"), e("1")], [])
    assert not ok([e("1")], [r()])
    assert not ok([e("1"), e("2")], [r(target_local_id="1")])
    assert not ok([e("1", aliases=["zz"])], [])
    assert not ok([e("1", confidence=2.0)], [])
    assert not ok([e("1"), e("2")], [r(evidence="zz")])
    assert not ok([e("1", name=" ")], [])


def test_selection(spark):
    src = spark.createDataFrame([("a", "pending", 1), ("b", "failed", 2), ("c", "active", 3), ("e", "deleted", 4)], "source_id string, status string, created_at int")
    d = spark.createDataFrame([("da", "a", 1, True, False), ("db", "b", 1, True, True), ("dc", "c", 1, True, False)], "document_id string, source_id string, generation int, is_active boolean, reset boolean")
    ch = spark.createDataFrame([("da", True), ("dc", True)], "document_id string, is_active boolean")
    su = spark.createDataFrame([("dc", True)], "document_id string, is_active boolean")
    assert rows(cognify.selected(src, d, ch, su), "source_id", "plan") == [("a", "resume"), ("b", "reset")]
    assert rows(cognify.selected(src, d, ch, su, force=True), "source_id", "plan") == [("a", "resume"), ("b", "reset"), ("c", "skip")]


def test_remember(spark):
    held = spark.createDataFrame([("s1", "d", "%s", 1, "active")], "source_id string, dataset_id string, content_sha256 string, version int, status string").withColumn("content_sha256", F.sha2(F.lit("one"), 256))
    items = spark.createDataFrame([("d", "a", "one", 1), ("d", "b", "two", 2), ("d", "c", "two", 3), ("e", "x", "one", 1)], "dataset_id string, name string, text string, created_at int")
    got = {r["name"]: r for r in remember.remembered(items, held).collect()}
    assert {k: v.outcome for k, v in got.items()} == {"a": "duplicate", "b": "created", "c": "duplicate", "x": "created"}
    assert got["a"].source_id == "s1" and got["c"].source_id == got["b"].source_id
    forced = {r["name"]: r.version for r in remember.remembered(items, held, force=True).collect()}
    assert forced == {"a": 2, "b": 1, "c": 2, "x": 1}


def test_idempotency(spark):
    runs = spark.createDataFrame([("k1", "h1", "succeeded", "{}"), ("k2", "h2", "running", None)], "idempotency_key string, payload_hash string, status string, output string")
    req = spark.createDataFrame([("k1", "h1"), ("k1", "hx"), ("k2", "h2"), ("k3", "h")], "idempotency_key string, payload_hash string")
    assert rows(remember.idempotent(req, runs), "idempotency_key", "payload_hash", "decision") == [("k1", "h1", "replay"), ("k1", "hx", "conflict"), ("k2", "h2", "conflict"), ("k3", "h", "run")]


def test_feedback_checks(spark):
    q = spark.createDataFrame([("q", json.dumps({"items": [{"chunk_id": "c"}]}))], "query_id string, references string")
    fb = spark.createDataFrame([("q", "answer", None, 1), ("q", "reference", "c", 0), ("q", "reference", "z", 0), ("x", "answer", None, 1), ("q", "answer", None, 5)], "query_id string, target_type string, target_id string, score int")
    assert [r.error for r in remember.checked_feedback(fb, q).orderBy("query_id", "target_type", "target_id", "score").collect()] == [None, "bad score", None, "bad target", "unknown query"]


def test_datasets(spark):
    sets = spark.createDataFrame([("1", "main", "main", "active", 1), ("2", "Old Name", "old", "active", 1)], "dataset_id string, name string, slug string, status string, active_generation int")
    new = spark.createDataFrame([("old name",), ("Old",), ("Fresh",), ("FRESH",), ("日本",)], "name string")
    assert rows(remember.created_datasets(new, sets).na.fill("ok", ["error"]), "name", "error") == [("FRESH", "ok"), ("Fresh", "name exists"), ("Old", "slug exists"), ("old name", "name exists"), ("日本", "invalid name")]
    assert rows(remember.renamed_dataset(sets, "2", "New"), "name", "slug") == [("New", "old"), ("main", "main")]
    with pytest.raises(ValueError):
        remember.renamed_dataset(sets, "1", "x")
    assert remember.main_dataset(sets).count() == 2 and remember.main_dataset(sets.where("slug = 'old'")).count() == 2


def test_forget_scope_rules():
    assert forget.forget_scope(source_id="s") == "source" and forget.forget_scope(dataset="d") == "dataset"
    assert forget.forget_scope(everything=True, confirm="DELETE EVERYTHING") == "everything"
    for bad in ({}, {"everything": True}, {"everything": True, "confirm": "x"}, {"source_id": "s", "confirm": "DELETE EVERYTHING"}, {"everything": True, "source_id": "s", "confirm": "DELETE EVERYTHING"}):
        with pytest.raises(ValueError):
            forget.forget_scope(**bad)


def test_forgetting_leaves_no_relation_without_evidence(spark, sf_dir):
    from quillgraph.plans.registry import order_tables

    t = order_tables(Fixture(spark, sf_dir))
    gone = forget.forget_sources(t, t["sources"].where("source_id % 3 = 0").select("source_id"))
    left = t["relations"].where("is_active").join(gone["relations"], "relation_id", "left_anti")
    chunks = t["chunks"].join(gone["chunks"], "chunk_id", "left_anti")
    before = t["relations"].where("is_active").join(t["evidence"], "relation_id", "left_anti").count()
    proof = t["evidence"].join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    assert left.join(proof, "relation_id", "left_anti").count() == before
    cmds = forget.forget_commands(gone, t)
    assert cmds.where("operation <> 'delete'").count() == 0 and cmds.where("aggregate_type = 'chunk'").count() == gone["chunks"].count()


def test_forget_everything_stops_at_the_first_conflict(spark):
    sets = spark.createDataFrame([("a", "active"), ("b", "deleting"), ("c", "active"), ("x", "deleted")], "dataset_id string, status string")
    docs = spark.createDataFrame([("1", "a", True), ("2", "c", True)], "document_id string, dataset_id string, is_active boolean")
    gone, out = forget.forget_everything({"datasets": sets, "documents": docs}, spark.createDataFrame([("b",)], "dataset_id string"))
    assert rows(out, "dataset_id", "outcome") == [("a", "forgotten"), ("b", "conflict"), ("c", "not_reached")]
    assert rows(gone["documents"], "document_id") == [("1",)]
    done = forget.finalised_datasets(sets, spark.createDataFrame([("b",)], "dataset_id string"))
    assert rows(done.where("dataset_id = 'b'"), "status") == [("active",)]


def test_concurrency_outcomes(spark):
    df = spark.createDataFrame([("h", None, None, "active"), ("h", "running", "h", "deleting"), ("h", "running", "z", "deleting"), ("h", "succeeded", "h", "deleted"), ("h", "failed", "h", "deleting")], "h string, ps string, ph string, ts string")
    got = [r.x for r in df.select(forget.concurrency_outcome(F.col("h"), F.col("ps"), F.col("ph"), F.col("ts")).alias("x")).collect()]
    assert got == ["mutated", "resumed", "blocked", "reentrant", "resumed"]


def test_importance_golden(spark):
    none = F.lit(None).cast("double")
    ents = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string").select("entity_id", F.lit(0.5).alias("importance_weight"), none.alias("feedback_weight"), none.alias("centrality_weight"))
    rel = spark.createDataFrame([("r1", "a", "b"), ("r2", "b", "c")], "relation_id string, source_entity_id string, target_entity_id string").select("*", F.lit(0.5).alias("importance_weight"), none.alias("feedback_weight"), none.alias("centrality_weight"))
    ev = spark.createDataFrame([("r1", "x")], "relation_id string, chunk_id string")
    got = improve.maintained(ents, rel, ev)
    assert rows(got["deactivated"], "relation_id") == [("r2",)]
    assert dict(rows(got["entities"], "entity_id", "importance_weight")) == {"a": 0.75, "b": 0.75, "c": 0.25}
    assert rows(got["relations"], "importance_weight") == [(0.75,)]
    again = improve.maintained(got["entities"], got["relations"].select(*rel.columns), ev)
    assert again["entities"].count() == 0 and again["relations"].count() == 0 and again["deactivated"].count() == 0


def test_stage_order():
    assert improve.checked_stages(None) == ["feedback", "deduplication", "relation_embeddings"]
    assert improve.checked_stages(["maintenance", "reconciliation", "feedback"]) == ["feedback", "reconciliation", "maintenance"]
    with pytest.raises(ValueError):
        improve.checked_stages(["x"])


def test_deduplication_flow(spark):
    ents = spark.createDataFrame([("a", "Acme", "org", [1.0, 0.0], ["Acme"], True, 1), ("b", "ACME", "Org ", [1.0, 0.01], [], True, 2), ("c", "Zed", "org", [0.0, 1.0], [], True, 3)], "entity_id string, name string, entity_type string, embedding array<float>, aliases array<string>, is_active boolean, created_rank int").withColumn("dataset_id", F.lit("d"))
    men = spark.createDataFrame([("b", "k")], "entity_id string, chunk_id string")
    rel = spark.createDataFrame([("r", "b", "c", "p", True, [1.0])], "relation_id string, source_entity_id string, target_entity_id string, predicate string, is_active boolean, embedding array<float>")
    ev = spark.createDataFrame([("r", "k", 0.5)], "relation_id string, chunk_id string, confidence double")
    got = improve.deduplicated(ents, men, rel, ev)
    assert rows(got["plan"], "entity_id", "survivor_id") == [("b", "a")]
    r = got["relations"].first()
    assert r.source_entity_id == "a" and r.embedding is None
    assert rows(got["entities"].where("is_active"), "entity_id") == [("a",), ("c",)]
    filled = improve.with_relation_vectors(got["relations"].withColumn("description", F.lit("")), ents)
    assert filled.first().embedding is not None
    assert improve.with_entity_vectors(ents.withColumn("embedding", F.lit(None).cast("array<float>"))).where("embedding is null").count() == 0


def test_summary_rebuild(spark):
    docs = spark.createDataFrame([("d1", "set", 1), ("d2", "set", 1)], "document_id string, dataset_id string, generation int")
    chunks = spark.createDataFrame([("d1", "set", 1, 0, "one", True), ("d2", "set", 1, 0, "two", True)], "document_id string, dataset_id string, generation int, ordinal int, text string, is_active boolean")
    have = spark.createDataFrame([("document", "d1", "document-summary-v1", "old", True), ("document", "d9", "document-summary-v1", "x", True)], "target_type string, target_id string, prompt_version string, text string, is_active boolean")
    got = improve.rebuilt_summaries(docs, chunks, have)
    assert rows(got["documents"], "document_id") == [("d2",)] and got["datasets"].count() == 1 and rows(got["deactivated"], "target_id") == [("d9",)]


def test_recall_modes(spark, sf_dir):
    t = Fixture(spark, sf_dir)
    from quillgraph.plans.registry import with_vectors

    vec = t.table("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    tables = {
        "datasets": t.datasets, "sources": t.sources, "documents": t.documents, "summaries": t.summaries, "chunks": t.chunks.join(vec, "document_id", "left"),
        "entities": spark.createDataFrame([("e1", "E1", "t", ""), ("e2", "E2", "t", "")], "entity_id string, name string, entity_type string, description string"),
        "relations": spark.createDataFrame([("r", "e1", "e2", "p", "", 0.5)], "relation_id string, source_entity_id string, target_entity_id string, predicate string, description string, confidence double"),
    }
    first = with_vectors(t).select("chunk_id").orderBy("chunk_id").limit(200)
    tables["mentions"] = first.select(F.lit("e1").alias("entity_id"), "chunk_id")
    tables["evidence"] = first.limit(3).select(F.lit("r").alias("relation_id"), "chunk_id", F.lit(0.5).alias("confidence"))
    q = t.table("embeddings").first()["embedding"]
    for mode in recall.MODES:
        out = recall.recall(tables, q, "the of", mode=mode, top_k=5)
        if mode == "summaries":
            assert out["summaries"].count() == 5
            continue
        assert out["hits"].count() == 5 and out["references"].count() >= 5
        assert out["context"].first()["context"] is not None or mode in ("graph", "triplets")
    out = recall.recall(tables, q, "the of", mode="rag", top_k=5)
    row = recall.audit_row(out["references"], "q", None, "hybrid", ["d"], None).first()
    assert len(json.loads(row["references"])["items"]) == out["references"].count()
    with pytest.raises(ValueError):
        recall.recall(tables, q, "x", mode="odd")


def test_lineage(spark):
    q = spark.createDataFrame([("q", json.dumps({"items": [{"source_id": "s", "document_id": "d", "chunk_id": "c1", "score": 0.5}, {"chunk_id": "gone"}]}))], "query_id string, references string")
    vis = spark.createDataFrame([("c1", "name", "a  b")], "chunk_id string, source_name string, text string")
    got = provenance.query_lineage(q, vis).orderBy("position").collect()
    assert [(r.available, r.quote, r.source_id) for r in got] == [(True, "a b", "s"), (False, None, provenance.ZERO)]


def test_queries_over_whole_tables(spark, sf_dir):
    t = Fixture(spark, sf_dir)
    chunk = {r.chunk_id for r in registry.visible(t).select("chunk_id").collect()}
    assert {r.chunk_id for r in registry.QUERIES["recall_references_all"](spark, sf_dir).collect()} == chunk
    orders = {r.o_orderkey for r in t.table("orders").collect()}
    assert {r.chunk_id for r in registry.QUERIES["graph_one_hop_all"](spark, sf_dir).select("chunk_id").distinct().collect()} == orders
    assert registry.QUERIES["provenance_query_all"](spark, sf_dir).count() == t.chunks.count()
    asked = {r.dataset_id for r in t.documents.where("is_active").select("dataset_id").distinct().collect()}
    assert len(asked) > 1 and {r.dataset_id for r in registry.QUERIES["cognify_graph"](spark, sf_dir).select("dataset_id").distinct().collect()} == asked


def test_recall_graph_reads_late_orders(spark, sf_dir, tmp_path):
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        moved = spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn(key, (F.col(key) + 1_000_000).cast("long"))
        moved.write.parquet(f"{tmp_path}/{name}.parquet")
    assert registry.QUERIES["recall_graph"](spark, str(tmp_path)).count() == 12


def test_entities_are_merged_in_one_pass(spark):
    kinds = "dataset_id string, canonical_key string, entity_id string, generation int, name string, type string, description string, aliases array<string>, confidence double, seen struct<document_id:long,ordinal:int,at:int>"
    found = spark.createDataFrame([
        ("d", "t:a", "1", 1, "A", "t", " ", ["x", "y"], 0.5, (1, 0, 1)), ("d", "t:a", "1", 2, "a", "t", "late", ["z", "x"], 0.9, (1, 1, 0)), ("d", "t:a", "1", 1, "first", "t", "said", ["y", "y"], 0.1, (1, 0, 0)),
        ("d", "t:b", "2", 1, "B", "t", "", [], 0.2, (2, 0, 0)), (None, "t:a", "3", 1, "N", "t", "", ["n"], 0.3, (3, 0, 0)),
    ], kinds)
    seen = spark.sparkContext.accumulator(0)

    def read(x):
        seen.add(1)
        return x

    got = {r.entity_id: r for r in cognify.merged_entities(found.withColumn("name", F.udf(read).asNondeterministic()("name"))).collect()}
    assert seen.value == 5
    assert got["1"].asDict() == {"dataset_id": "d", "canonical_key": "t:a", "entity_id": "1", "generation": 2, "name": "first", "entity_type": "t", "description": "said", "confidence": 0.9, "aliases": ["y", "x", "z"]}
    assert got["2"].aliases == [] and got["2"].description == "" and got["3"].aliases == ["n"]


def test_a_word_is_hashed_once(monkeypatch):
    made = []
    real = hashlib.blake2b
    monkeypatch.setattr(providers.hashlib, "blake2b", lambda *a, **k: made.append(a) or real(*a, **k))
    one, two = providers.HashEmbedding(8).embed_texts(["onceonly hashed onceonly", "hashed Onceonly hashed"])
    assert len(made) == 2 and len(one) == 8 and one != two
    assert providers.CapitalizedExtraction(2).extract("One Two One Three")["entities"][-1]["name"] == "Two"

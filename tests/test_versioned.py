"""Versions under two writers; forgetting by counts and ingest against the base version, both against plain recomputation."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import scope
from quillgraph.plans import forget, support
from quillgraph.session import sifted
from quillgraph.sources.versioned import Conflict, Versions, bucket_of

KEY = "k"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string").coalesce(1)


def put(value, *keys):
    """A change that writes ``value`` at some keys, reading only their buckets."""

    def change(v, manifest):
        new = rows(v.spark, *((k, value) for k in keys))
        at = sorted(r[0] for r in new.select(bucket_of(KEY)).distinct().collect())
        rest = v.read("t", manifest=manifest, buckets=at).join(new.select("k"), "k", "left_anti")
        return {"t": v.write("t", rest.unionByName(new), bucket_of(KEY), at)}

    return change


def held(v, version=None):
    return {r.k: r.v for r in v.read("t", manifest=v.current(version)[1]).collect()}


def test_two_writers(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    assert v.current() == (0, {})
    assert v.create({"t": (rows(spark, (1, "a"), (2, "a"), (3, "a")), bucket_of(KEY))}) == 1
    with pytest.raises(Conflict):
        v.create({"t": (rows(spark, (9, "z")), bucket_of(KEY))})
    buckets = {r.k: r.b for r in rows(spark, (1, ""), (2, ""), (3, "")).select("k", bucket_of(KEY).alias("b")).collect()}
    assert buckets[1] != buckets[2]
    base, manifest = v.current()
    mine, theirs = put("mine", 1)(v, manifest), put("theirs", 2)(v, manifest)
    assert v.commit(base, theirs) == 2
    assert v.commit(base, mine) == 3  # other buckets: moved behind
    assert held(v) == {1: "mine", 2: "theirs", 3: "a"} and held(v, 1) == {1: "a", 2: "a", 3: "a"}
    late = put("late", 1)(v, manifest)
    with pytest.raises(Conflict):
        v.commit(base, late)
    assert held(v)[1] == "mine"
    tries = []

    def raced(w, m):
        tries.append(1)
        out = put(f"try{len(tries)}", 1)(w, m)
        if len(tries) == 1:
            w.update(put("between", 1))
        return out

    v.update(raced)
    assert held(v)[1] == "try2" and len(tries) == 2
    with pytest.raises(LookupError):
        v.current(99)


def test_a_dead_writer_leaves_nothing(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    v.create({"t": (rows(spark, (1, "a")), bucket_of(KEY))})

    def dies(w, m):
        put("half", 1)(w, m)
        raise OSError("lost")

    with pytest.raises(OSError):
        v.update(dies)
    assert v.current()[0] == 1 and held(v) == {1: "a"}


def graph(rng):
    chunks = [(k, rng.randrange(12), k, f"d{rng.randrange(2)}", 1, rng.random() > 0.1) for k in range(120)]
    ents, rels = [f"e{k}" for k in range(30)], []
    for k in range(60):
        rels.append((f"r{k}", rng.choice(ents), rng.choice(ents), rng.random() > 0.1))
    evidence = [(rng.choice(rels)[0], rng.randrange(130)) for _ in range(90)]
    mentions = [(rng.choice(ents), rng.randrange(130)) for _ in range(70)]
    return chunks, rels, evidence, mentions


def tables(spark, g, gone=()):
    chunks, rels, evidence, mentions = g
    c = spark.createDataFrame([(*x, 0, "", 0, 0) for x in chunks], "chunk_id long, source_id long, document_id long, dataset_id string, generation int, is_active boolean, ordinal int, text string, start_char int, end_char int")
    docs = c.select("document_id", "source_id", "dataset_id", "generation", F.lit(True).alias("is_active"))
    src = spark.createDataFrame([(s, f"d{d}", "deleted" if s == 11 else "active", "n") for s in range(12) for d in (0, 1)], "source_id long, dataset_id string, status string, name string")
    sets = spark.createDataFrame([(f"d{k}", f"d{k}", "active", 1) for k in (0, 1)], "dataset_id string, slug string, status string, active_generation int")
    return {
        "datasets": sets, "sources": src, "documents": docs, "chunks": c,
        "relations": spark.createDataFrame(rels, "relation_id string, source_entity_id string, target_entity_id string, is_active boolean"),
        "evidence": spark.createDataFrame(evidence, "relation_id string, chunk_id long"), "mentions": spark.createDataFrame(mentions, "entity_id string, chunk_id long"),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_forgetting_by_counts(spark, tmp_path, seed):
    rng = random.Random(seed)
    chunks, rels, evidence, mentions = graph(rng)
    t = tables(spark, (chunks, rels, evidence, mentions))
    v = Versions(spark, str(tmp_path / "s"))
    assert support.build(t, v) == 1
    for hit in ([3], [1, 5, 77], list(range(12))):
        ids = spark.createDataFrame([(s,) for s in hit], "source_id long")
        want = forget.forget_sources(t, ids)
        number, gone = support.forget(v, ids)
        for k, key in (("relations", "relation_id"), ("entities", "entity_id")):
            assert {r[0] for r in gone[k].collect()} == {r[0] for r in want[k].select(key).collect()}, (hit, k)
        dead = {r[0] for r in want["relations"].collect()}
        lost = {r[0] for r in want["chunks"].collect()}
        chunks = [(*x[:5], x[5] and x[0] not in lost) for x in chunks]
        rels = [(*x[:3], x[3] and x[0] not in dead) for x in rels]
        t = tables(spark, (chunks, rels, evidence, mentions))
        fresh = {(r.kind, r.id): (r.n, r.ends, r.is_active) for r in support.counts(t, support.links(t)).collect() if r.n or r.ends or (r.kind == "relation" and r.is_active)}
        stored = {(r.kind, r.id): (r.n, r.ends, r.is_active) for r in v.read("counts").collect() if r.n or r.ends or (r.kind == "relation" and r.is_active)}
        assert stored == fresh
    assert v.current()[0] == 4 and v.read("links").count() == 0


def test_support_reads_relations_once(spark, tmp_path):
    g = graph(random.Random(3))
    t = tables(spark, g)
    seen = spark.sparkContext.accumulator(0)

    def read(x):
        seen.add(1)
        return x

    t["relations"] = t["relations"].withColumn("source_entity_id", F.udf(read).asNondeterministic()("source_entity_id"))
    support.build(t, Versions(spark, str(tmp_path / "s")))
    assert seen.value == len(g[1])


def test_current_chunks_are_visible_as_in_scope(spark):
    t = tables(spark, graph(random.Random(7)))
    t["documents"] = t["documents"].withColumn("is_active", F.expr("document_id % 5 <> 0")).withColumn("generation", F.expr("if(document_id % 7 = 0, 2, 1)"))
    t["documents"], t["sources"] = t["documents"].union(t["documents"]), t["sources"].union(t["sources"].where("source_id = 3")).where("source_id <> 4 or dataset_id = 'd0'")
    seen = {r[0] for r in scope.authoritative_chunks(t["chunks"], t["documents"], t["sources"], t["datasets"]).select("chunk_id").collect()}
    got = support.current_chunks(t).collect()
    assert seen and {r.chunk_id for r in got if r.visible} == seen
    assert sorted((r.chunk_id, r.source_id) for r in got) == sorted((r.chunk_id, r.source_id) for r in t["chunks"].where("is_active").collect())


def test_support_keeps_no_shuffles(spark, tmp_path):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_")}

    t = tables(spark, graph(random.Random(4)))
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    settings = {k: spark.conf.get(k, None) for k in (clean, first)}
    before = shuffled()
    v = Versions(spark, str(tmp_path / "s"))
    support.build(t, v)
    for _ in range(50):  # files are dropped beside the driver's work
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert {k: spark.conf.get(k, None) for k in settings} == settings


def test_hot_relations_are_counted_before_they_are_dealt(spark, monkeypatch):
    g = graph(random.Random(6))
    t = tables(spark, (*g[:2], g[2] + [("r7", k) for k in range(100)] + [(None, k) for k in range(100)], g[3]))
    every, rows = support.kept(support.links(t)), lambda df: sorted(map(str, df.collect()))
    monkeypatch.setattr(support, "HOT", 50)
    hot = support.hot_slots(every)
    assert len(hot) == 2
    assert rows(support.relation_counts(t, every, hot)) == rows(support.relation_counts(t, every))


def test_counts_lie_in_few_files(spark, tmp_path):
    """Tasks of rows dealt by id write to the buckets of their own shares, not each to all buckets."""
    rels = [(f"r{k}", f"e{k}", f"e{k + 1}", True) for k in range(3000)]
    t = tables(spark, ([(k, k % 12, k, "d0", 1, True) for k in range(120)], rels, [(r[0], k % 120) for k, r in enumerate(rels)], [("e1", 1)]))
    share = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(share, None)
    spark.conf.set(share, "4k")
    try:
        v = Versions(spark, str(tmp_path / "s"))
        support.build(t, v)
    finally:
        spark.conf.set(share, before) if before else spark.conf.unset(share)
    assert v.read("counts").where("kind = 'relation'").count() == 3000
    assert len(v.read("counts").inputFiles()) <= 2 * 32  # a file a share and kind


def test_relations_dealt_by_id(spark, sf_dir):
    from quillgraph.plans.registry import order_tables, relations_by_id
    from quillgraph.sources.fixtures import Fixture

    t = Fixture(spark, sf_dir)
    want, got = t.relations.where("is_active"), relations_by_id(t).select(t.relations.columns)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    links = spark.createDataFrame([("c1-R-p1", True)], "id string, visible boolean").withColumn("kind", F.lit("relation"))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        plan = support.relation_counts(order_tables(t) | {"relations": relations_by_id(t)}, links)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, before) if before else spark.conf.unset(limit)
    assert plan.count("Exchange hashpartitioning") == 4, plan  # lineitem, orders, relations, links


def test_forgetting_deals_only_counts_touched(spark):
    every = spark.range(2000).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("relation").alias("kind"), F.lit(1).alias("n"))
    less = support.kept(spark.range(20).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("relation").alias("kind"), F.lit(1).alias("less")))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        for n in (0, 20):
            with sifted(spark, n):
                out = every.join(less.where("less >= 0"), ["id", "kind"])
                assert "might_contain" in out._jdf.queryExecution().optimizedPlan().toString()
                assert out.count() == 20
        with sifted(spark, 0):
            assert every.join(less.where("less > 5"), ["id", "kind"]).count() == 0
    finally:
        spark.conf.set(limit, before) if before else spark.conf.unset(limit)


def test_forgetting_many_sources(spark, tmp_path, monkeypatch):
    """Above ``SMALL`` sources their ids are not broadcast; the same goes."""
    t = tables(spark, graph(random.Random(5)))
    v = Versions(spark, str(tmp_path / "s"))
    support.build(t, v)
    ids = spark.createDataFrame([(s,) for s in (1, 4, 5, 9)], "source_id long")
    gone = []
    for most in (support.SMALL, 0):
        monkeypatch.setattr(support, "SMALL", most)
        out = support.removed(v, v.current()[1], ids)
        gone.append({k: sorted(map(str, out[k].collect())) for k in ("chunks", "relations", "entities", "counts")})
    assert gone[0] == gone[1] and gone[0]["relations"]
    named = support.removed(v, v.current()[1], spark.createDataFrame([("4",), ("05",), ("x",)], "source_id string"))
    assert sorted(named["chunks"].collect()) == sorted(support.removed(v, v.current()[1], ids.where("source_id = 4"))["chunks"].collect()) and not named["chunks"].isEmpty()
    assert all(not x.collect() for x in (support.removed(v, v.current()[1], ids.where("false"))[k] for k in ("chunks", "relations", "entities")))


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    many = spark.range(0, 60000, 1, 6).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    share = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(share, None)
    spark.conf.set(share, "256k")
    try:
        v = Versions(spark, str(tmp_path / "v"))
        v.create({"t": (many, F.lit(5))})
    finally:
        spark.conf.set(share, before) if before else spark.conf.unset(share)
    assert v.read("t").count() == 60000 and v.read("t", buckets=[4]).isEmpty()
    assert len(v.read("t", buckets=[5]).inputFiles()) > 1


def test_ingest_of_two_writers(spark, tmp_path):
    kinds = "source_id string, dataset_id string, name string, content_sha256 string, version int, status string"
    v = Versions(spark, str(tmp_path / "i"))
    first = spark.createDataFrame([("s0", "d", "old", "0" * 64, 1, "active")], kinds)
    v.create({"sources": (first, bucket_of(*support.content_key()))})
    item = lambda *texts: spark.createDataFrame([("d", f"n{x}", x, k) for k, x in enumerate(texts)], "dataset_id string, name string, text string, created_at int").withColumn("created_at", F.timestamp_seconds("created_at"))
    raced = []
    read = v.read

    def between(table, **options):
        if not raced:
            raced.append(1)
            support.ingest(Versions(spark, v.root), item("same"))
        return read(table, **options)

    manifest = v.current()[1]
    v.read = between
    number, out = support.ingest(v, item("same", "other", "same"))
    assert {(r.text, r.outcome) for r in out.collect()} == {("same", "duplicate"), ("other", "created")} and number == 3
    v.read = read
    number, out = support.ingest(v, item("same"), force=True)
    assert [r.version for r in out.collect()] == [2]
    assert sorted((r.name, r.version) for r in v.read("sources").collect()) == [("nother", 1), ("nsame", 1), ("nsame", 2), ("old", 1)]
    assert v.read("sources", manifest=manifest).count() == 1

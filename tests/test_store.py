"""Snapshots, the step engine, the rebuild command and the rank-file counter."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.chunker import chunk_documents, rank_counter
from quillgraph.plans import engine, rebuild
from quillgraph.sources import store
from quillgraph.sources.fixtures import Fixture


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "s")
    with pytest.raises(LookupError):
        store.current(spark, root)
    assert store.publish({"a": spark.range(3), "b": spark.range(2)}, root) == 1
    assert store.publish({"a": spark.range(5)}, root) == 2
    spark.range(9).write.parquet(f"{root}/snapshot=3/a")  # not published
    assert store.current(spark, root)["a"].count() == 5 and store.current(spark, root, 1)["b"].count() == 2 and store.versions(spark, root) == [1, 2]


def test_engine(spark, tmp_path):
    calls = []

    def step(name, needs, k):
        def run(inputs, params):
            calls.append(name)
            return inputs[needs[0]].select((F.col("id") + params["k"]).alias("id"))

        return engine.Step(name, run, needs, params={"k": k})

    def go(k, stop=lambda: False):
        calls.clear()
        return engine.execute(spark, [step("a", ("in",), 1), step("b", ("a",), k), step("c", ("in",), 5)], {"in": spark.range(3)}, {"in": "v1"}, str(tmp_path / "r"), cancelled=stop)

    t, out = go(2)
    assert out == {"a": "ran", "b": "ran", "c": "ran"} and sorted(r.id for r in t["b"].collect()) == [3, 4, 5]
    assert go(2)[1] == {"a": "skipped", "b": "skipped", "c": "skipped"} and calls == []
    assert go(7)[1] == {"a": "skipped", "b": "ran", "c": "skipped"}
    assert set(go(9, lambda: True)[1].values()) == {"cancelled"}
    with pytest.raises(ValueError):
        engine.checked([step("a", ("zz",), 1)], {"in"})


def test_rebuild_command(spark, sf_dir, tmp_path):
    f = Fixture(spark, sf_dir)
    ents = spark.createDataFrame([("e1", "en", 1, True), ("e2", "en", 1, True)], "entity_id string, dataset_id string, generation int, is_active boolean")
    rel = spark.createDataFrame([("r", "en", "e1", "e2", 1, True), ("s", "en", "e1", "zz", 1, True)], "relation_id string, dataset_id string, source_entity_id string, target_entity_id string, generation int, is_active boolean")
    men = f.chunks.where("dataset_id = 'en'").limit(5).select(F.lit("e1").alias("entity_id"), "chunk_id")
    root, out = str(tmp_path / "s"), str(tmp_path / "o")
    store.publish({"datasets": f.datasets, "entities": ents, "chunks": f.chunks, "mentions": men, "relations": rel}, root)
    assert rebuild.main([root, out, "--all", "--confirm"]) == 0
    whole = spark.read.parquet(out).count()
    assert rebuild.main([root, out, "--dataset", "en"]) == 0
    got = spark.read.parquet(out)
    assert got.count() == whole and got.where("kind = 'relation'").count() == 1
    with pytest.raises(SystemExit):
        rebuild.main([root, out, "--all"])
    with pytest.raises(LookupError):
        rebuild.rebuild(spark, root, out, "nope")


def test_rank_file_counter(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([("d", 1, "One two three four. " * 30)], "document_id string, generation int, normalized_text string")
    rows = chunk_documents(docs, most=20, overlap=4, least=3, counter=rank_counter(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)).collect()
    assert len(rows) > 5 and all(0 < r.token_count <= 20 for r in rows)


def test_shuffles_begin_in_proportion_to_the_input(spark):
    from quillgraph import session

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    try:
        session.dealt(spark, 400 * session.PART)
        assert int(spark.conf.get(key)) >= 400
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_names_of_relations_are_made_after_the_grouping(spark, sf_dir):
    from quillgraph.sources.fixtures import SPARK, VIEWS, Fixture, _named

    for name in ("f_relations", "f_evidence", "f_mentions"):
        t = Fixture(spark, sf_dir)
        sql = VIEWS[name].format(**SPARK)
        used = {n: t.table(n) for n in ("lineitem", "orders")}
        # Some keys null: a null name is one group.
        used["lineitem"] = used["lineitem"].selectExpr("* except (l_partkey)", "if(l_partkey % 9 = 0, null, l_partkey) as l_partkey")
        t._made.update(used)
        for n in used:
            sql = _named(sql, n)
        want = spark.sql(sql, **used)
        assert t.view(name).schema.simpleString() == want.schema.simpleString()
        assert t.view(name).exceptAll(want).isEmpty() and want.exceptAll(t.view(name)).isEmpty()
        exchanges = [line for line in t.view(name)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
        assert not any("concat" in line or "_groupingexpression" in line and name == "f_relations" for line in exchanges), exchanges


def test_a_large_share_of_the_session_is_lowered(spark):
    from quillgraph.session import SHARE, dealt

    share = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(share, None)
    try:
        for named, want in (("64m", SHARE), ("67108864b", SHARE), ("1m", "1m"), (SHARE, SHARE)):
            spark.conf.set(share, named)
            dealt(spark, 1)
            assert spark.conf.get(share) == want
    finally:
        spark.conf.set(share, before) if before else spark.conf.unset(share)

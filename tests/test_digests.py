"""Reconciliation by digests against the full outer join of all identities."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import digests, projection

IDS = "dataset_id string, kind string, id string"


def sides(rng, n, drop, add):
    want = [(rng.choice("ab"), rng.choice(["entity", "chunk"]), f"i{k}") for k in range(n)] + [(None, "chunk", "none")]
    have = [x for x in want if rng.random() >= drop] + [("a", "entity", f"new{k}") for k in range(add)] + ([("z", "chunk", "alone")] if add else [])
    return want, have


def built(spark, rows, path):
    return digests.IdentityStore.build(spark.createDataFrame(rows, IDS).repartition(3), str(path))


@pytest.mark.parametrize("drop, add", [(0.01, 2), (0.5, 30), (0, 0), (1, 0)])
def test_reconciled(spark, tmp_path, drop, add):
    want, have = sides(random.Random(1), 800, drop, add)
    a, b = built(spark, want, tmp_path / "a"), built(spark, have, tmp_path / "b")
    plain = projection.reconciled(spark.createDataFrame(want, IDS), spark.createDataFrame(have, IDS)).where("dataset_id is not null")
    got = {tuple(r) for r in digests.reconciled(a, b).where("dataset_id is not null").collect()}
    assert got == {tuple(r) for r in plain.collect()}


def test_only_ranges_that_differ_are_read(spark, tmp_path):
    want, _ = sides(random.Random(2), 3000, 0, 0)
    a, b = built(spark, want, tmp_path / "a"), built(spark, want[:-5], tmp_path / "b")
    assert digests.differing(a.groups(), a.groups(), *digests.KEY, "group").isEmpty()
    groups = digests.differing(a.groups(), b.groups(), *digests.KEY, "group").select("group").distinct().count()
    assert 1 <= groups <= 5
    plan = digests.reconciled(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [group" in plan.replace("isnotnull(group", "group") or "group IN" in plan or "group#" in plan


def test_digests_add_up_in_any_order(spark, tmp_path):
    want, _ = sides(random.Random(3), 500, 0, 0)
    a = built(spark, want, tmp_path / "a")
    b = built(spark, want[::-1] + want[:50], tmp_path / "b")  # repeated identities count once
    assert digests.differing(a.groups(), b.groups(), *digests.KEY, "group").isEmpty()
    assert digests.differing(digests.summed(a.digests(), "kind"), digests.summed(b.digests(), "kind"), "kind").isEmpty()
    assert a.groups().agg(F.sum("n")).first()[0] == len(want)


def test_reconciled_like_a_full_outer_join(spark):
    """repeats count once, an identity with a null is equal to none of the other side; sides may come as one table."""
    want = [("d", "chunk", "1"), ("d", "chunk", "1"), ("d", "chunk", "2"), (None, "chunk", "3"), ("e", "entity", None)]
    have = [("d", "chunk", "2"), ("d", "chunk", "9"), ("d", "chunk", "9"), (None, "chunk", "3"), ("e", "entity", None)]
    out = {("d", "chunk", 2, 2, 1, 1), (None, "chunk", 1, 1, 1, 1), ("e", "entity", 1, 1, 1, 1)}
    a, b = spark.createDataFrame(want, IDS), spark.createDataFrame(have, IDS)
    assert {tuple(r) for r in projection.reconciled(a, b).collect()} == out
    both = [(*r, r in want, r in have) for r in [*want, *have]]
    assert {tuple(r) for r in projection.compared(spark.createDataFrame(both, f"{IDS}, wanted boolean, there boolean")).collect()} == out


def test_identities_are_dealt_once(spark, tmp_path):
    """both sides meet in one exchange of a stated number of partitions; the graph is not read for each side."""
    rows = spark.createDataFrame([("d", "chunk", str(k)) for k in range(50)], IDS)
    plan = projection.reconciled(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "FullOuter" not in plan
    reads = spark.sparkContext.accumulator(0)
    seen = spark.createDataFrame(rows.rdd.map(lambda r: (reads.add(1), r)[1]), IDS)
    digests.IdentityStore.build(seen, str(tmp_path / "s"))
    assert reads.value == 50

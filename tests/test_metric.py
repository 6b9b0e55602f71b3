"""Pivot index and pruned similarity join against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import dedup, metric


def clusters(rng, n, k, width=16, noise=0.05):
    centres = rng.normal(size=(k, width))
    return centres[rng.integers(0, k, n)] + noise * rng.normal(size=(n, width))


def frame(spark, vectors, extra=()):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


ODD = [(10_000, None), (10_001, [0.0] * 16), (10_002, [1.0] * 15), (10_003, [float("nan")] * 16), (10_004, [None] * 16), (10_005, [])]


@pytest.mark.parametrize("noise", [0.05, 5.0])
def test_top_k(spark, tmp_path, noise):
    rng = np.random.default_rng(1)
    v = clusters(rng, 1500, 30, noise=noise)
    v[5] = v[6] = v[7] * 2  # ties
    index = metric.MetricIndex.build(frame(spark, v, ODD), str(tmp_path / "i"), id_col="vec_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (v[7], rng.normal(size=16), -v[0]):
        s = u @ (q / np.linalg.norm(q))
        want = sorted(range(len(v)), key=lambda i: (-round(s[i], 9), i))[:20]
        got, share = index.top_k([float(x) for x in q], 20)
        rows = got.collect()
        assert {r.id for r in rows} == set(want) and np.allclose([r.score for r in rows], s[want])
        assert share < 0.5 or noise > 1 or q is not v[7]
    some = spark.range(0, 1500, 3)
    got = [r.id for r in index.top_k([float(x) for x in v[7]], 10, only=some)[0].collect()]
    s = u @ u[7]
    assert set(got) == set(sorted(range(0, 1500, 3), key=lambda i: (-round(s[i], 9), i))[:10])
    assert index.top_k([0.0] * 16, 5)[0].count() == 0 and index.top_k([1.0], 5)[0].count() == 0
    assert index.top_k([float(x) for x in v[7]], 5000)[0].count() == 1500


def test_empty(spark, tmp_path):
    index = metric.MetricIndex.build(frame(spark, [], ODD[:2]), str(tmp_path / "i"), id_col="vec_id")
    assert index.top_k([1.0] * 16, 5)[0].count() == 0


@pytest.mark.parametrize("threshold, noise, tile", [(0.95, 0.05, 64), (0.5, 0.3, 100), (0.9, 5.0, 64), (0.95, 0.05, 5000)])
def test_similar_pairs(spark, threshold, noise, tile):
    rng = np.random.default_rng(3)
    v = clusters(rng, 900, 25, noise=noise)
    types = ["A" if i % 3 else "b" for i in range(len(v))]
    rows = [(i, t, [float(y) for y in x]) for i, (t, x) in enumerate(zip(types, v, strict=True))] + [(i, "a", e) for i, e in ODD] + [(20_000, None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "entity_id long, entity_type string, embedding array<double>").repartition(4)
    got = {(r.entity_id, r.candidate_id): r.similarity for r in dedup.duplicate_candidates(df, threshold, tile=tile).collect()}
    s = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if types[i] == types[j] and s[i, j] >= threshold}
    assert set(got) == want and all(abs(got[p] - s[p]) < 1e-9 for p in got)


def test_rows_travel_few_times_in_clusters(spark):
    """On clustered rows the pairs come from far fewer rows than tiles of all rows would copy."""
    rng = np.random.default_rng(4)
    n, tile = 6000, 64
    df = frame(spark, clusters(rng, n, 200, noise=0.02)).select(F.lit("x").alias("block"), F.col("vec_id").alias("id"), "embedding")
    assert n < metric.placed_rows(df, 0.95, tile=tile).count() < n * np.log2(n)
    assert metric.similar_pairs(df, 0.95, tile=tile).count() > n

"""Containment in metadata through the stored index against plain containment."""

import json
import random

from quillgraph.operators.metadata_index import MetadataIndex


def inside(big, small):
    if isinstance(small, dict):
        return isinstance(big, dict) and all(k in big and inside(big[k], v) for k, v in small.items())
    if isinstance(small, list):
        return isinstance(big, list) and all(any(inside(b, s) for b in big) for s in small)
    if isinstance(big, bool) or isinstance(small, bool):
        return big is small
    return not isinstance(big, (dict, list)) and big == small


def value(rng, depth=3):
    kind = rng.randrange(7 if depth else 5)
    if kind < 5:
        return [rng.choice(["a", "b", "é", ""]), rng.choice([0, 1, 1.0, 2.5]), True, None, False][kind]
    if kind == 5:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["x", "y", "0", "z.w"]): value(rng, depth - 1) for _ in range(rng.randrange(4))}


def rows(rng, n):
    return [{rng.choice(["x", "y", "0"]): value(rng) for _ in range(rng.randrange(4))} for _ in range(n)]


def test_containment(spark, tmp_path):
    rng = random.Random(3)
    docs = rows(rng, 400)
    texts = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, None), (901, "{"), (902, ""), (903, "[1]"), (None, "{}"), (904, "[" * 100_000), (0, json.dumps(docs[0]))]
    df = spark.createDataFrame(texts, "source_id long, metadata string").selectExpr("*", "1 as id", "2 as key")
    index = MetadataIndex.build(df, str(tmp_path / "i"))
    for wanted in [{}, {"x": 1}, {"x": True}, {"y": None}, {"x": []}, {"0": {}}, {"x": [{"y": 1}]}, {"absent": "v"}, *rows(rng, 8)]:
        found = index.containing(df, wanted)
        assert found.columns == df.columns
        want = sorted([i for i, d in enumerate(docs) if inside(d, wanted)] + [0] * inside(docs[0], wanted))
        assert sorted(r.source_id for r in found.collect()) == want, wanted


def test_the_filter_reaches_the_scan(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id as source_id", """concat('{"lang":"', if(id % 3 = 0, 'en', string(id)), '"}') as metadata""")
    index = MetadataIndex.build(df, str(tmp_path / "i"))
    named = index.candidates({"lang": "en"})
    assert "PushedFilters: [In(key" in named._jdf.queryExecution().toString()
    assert named.count() == 6667
    assert index.candidates({"lang": "17"}).collect()[0].id == 17


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "source_id long, metadata string")
    assert MetadataIndex.build(df, str(tmp_path / "i")).containing(df, {"a": 1}).count() == 0

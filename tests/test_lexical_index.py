"""The stored lexical index and cover density against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import lexical
from quillgraph.functions.chunker import TOKENS, spans
from quillgraph.operators import lexical_index, search
from quillgraph.operators.lexical_index import LexicalIndex


def brute_density(positions):
    """All stretches that hold every word and no shorter stretch that does; by trying each pair of ends."""
    if not positions or any(not p for p in positions):
        return 0.0
    events = sorted(p for ps in positions for p in ps)
    whole = [(a, b) for a in events for b in events if a <= b and all(any(a <= p <= b for p in ps) for ps in positions)]
    least = [(a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for p in events) - 1)) for a, b in least)


@pytest.mark.parametrize("seed", range(3))
def test_cover_density(seed):
    rng = random.Random(seed)
    for _ in range(300):
        places = rng.sample(range(1, 60), rng.randrange(1, 16))
        lists = [sorted(places[k::3]) for k in range(rng.randrange(1, 4))]
        assert abs(lexical.cover_density(lists) - brute_density(lists)) < 1e-12


def test_cover_density_is_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        lists = [list(range(k, 3 * n, 3)) for k in range(3)]
        began = time.process_time()
        lexical.cover_density(lists)
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.01)


def texts(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "eps", "Beta", "über", "x1"]
    return [(k * 7, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for k in range(n)] + [(100_000, None), (100_001, ""), (100_002, "alpha " * 40_000 + "beta")]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rows = texts(random.Random(4), 400)
    df = spark.createDataFrame(rows, "chunk_id long, text string").repartition(5)
    return df, LexicalIndex.build(df, str(tmp_path_factory.mktemp("index") / "i"), buckets=5, block=8)


QUERIES = ["alpha beta", "beta", "alpha -gamma", '"alpha beta" delta', "alpha beta or über x1", "-alpha", "nowhere", "alpha nowhere or x1", "", "BETA beta"]


@pytest.mark.parametrize("text", QUERIES)
def test_top_k(spark, both, text):
    df, index = both
    q = lexical.parse_query(text)
    found = search.lexical_top_k(df.where("text is not null"), q, 10**6).collect()
    nulls = [(100_000, 0.0)] if any(all(t.negated for t in b) for b in q.branches) else []
    want = sorted([(r.chunk_id, round(r.rank_score, 9)) for r in found] + nulls, key=lambda x: (-x[1], x[0]))
    for k in (3, 10_000):
        assert [(r.chunk_id, r.rank_score) for r in index.top_k(q, k, first=2).collect()] == want[:k]
    ids = spark.createDataFrame([(i,) for i, _ in want[::2]], "chunk_id long")
    assert [r.chunk_id for r in index.top_k(q, 3, first=2, within=ids).collect()] == [i for i, _ in want[::2]][:3]


def test_blocks_under_the_bound_are_left(both):
    _, index = both
    q = lexical.parse_query("alpha beta")
    bounds = index.bounds(q)
    best = index.top_k(q, 1, first=1).first()
    assert bounds.where(f"bound < {best.rank_score}").count() > 0
    assert all(r.bound >= best.rank_score - 1e-9 for r in bounds.collect() if index.ranked(q, lexical.F.col("block") == r.block).where(f"chunk_id = {best.chunk_id}").count())


def test_plan_reads_the_words_folders_only(both):
    _, index = both
    plan = index.ranked(lexical.parse_query("alpha"))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*lexeme", plan) and "text" not in plan.split("== Physical Plan ==")[1]


def test_native_ranks(spark, both):
    df, index = both
    for words in (["alpha"], ["alpha", "beta"], ["alpha", "beta", "gamma"]):
        got = {r.chunk_id: r.rank_score for r in search.cover_ranks(df, words).collect()}
        want = {r.chunk_id: r.rank_score for r in index.ranked(lexical.parse_query(" ".join(words))).collect()}
        assert got == want


def model_spans(text, most, overlap, least):
    """The written rules, place by place: a span begins at 0 or where the overlap begins, blanks included."""
    count = lambda a, b: len(TOKENS.findall(text[a:b]))
    out, start = [], 0
    while start < len(text):
        if count(start, len(text)) <= most:
            end = len(text)
        else:
            reach = max(e for e in range(start + 1, len(text) + 1) if count(start, e) <= most)
            end = reach
            for mark in ("\n\n", "\n"):
                at = text.rfind(mark, start + 1, reach + 1)
                if at > start:
                    end = at + len(mark)
                    break
        out.append((start, end))
        if end >= len(text):
            break
        again = end
        if overlap and count(start, end) > overlap:
            again = min(m for m in range(start, end + 1) if count(m, end) <= overlap)
        start = again if again > start else end
    if len(out) > 1 and count(*out[-1]) < least and count(out[-2][0], out[-1][1]) <= most:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_spans_equal_the_written_rules(seed):
    rng = random.Random(seed)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "c", " ", "  ", "\n", "\n\n", ".", "é1"]) for _ in range(rng.randrange(50)))
        most = rng.randrange(1, 9)
        overlap, least = rng.randrange(most), rng.randrange(1, most + 1)
        assert spans(text, most=most, overlap=overlap, least=least) == model_spans(text, most, overlap, least)
    assert [a for a, _ in spans("  alpha beta gamma delta", most=2, overlap=1, least=1)][:2] == [0, 7]
    assert spans("   ", most=2, overlap=1, least=1) == [(0, 3)] and spans("", most=2, overlap=1, least=1) == []


def test_postings_are_those_of_the_vectors(spark, tmp_path):
    texts = ["b a b", "", None, "A a ä", "... !", "c " * 3, "b c a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    index = lexical_index.LexicalIndex.build(df, str(tmp_path / "i"), buckets=4, block=2)
    got = index.every_posting.selectExpr("lexeme", "most", "inline(posts)").collect()
    want = df.select("chunk_id", F.explode(lexical.to_vector(F.coalesce("text", F.lit("")))).alias("lexeme", "positions")).collect()
    assert sorted((r.lexeme, r.chunk_id, r.positions) for r in got) == sorted((r.lexeme, r.chunk_id, r.positions) for r in want)
    assert all(r.most >= len(r.positions) for r in got)


def test_building_groups_no_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(F, "collect_list", lambda *_: pytest.fail("a row of the shuffle for each chunk and lexeme"))
    df = spark.createDataFrame([(k, f"x{k} y") for k in range(9)], "chunk_id long, text string")
    assert lexical_index.LexicalIndex.build(df, str(tmp_path / "i")).every_posting.where("lexeme = 'y'").selectExpr("explode(posts)").count() == 9

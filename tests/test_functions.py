"""Scalar functions, rounding, lexical search and the chunker against plain Python."""

import hashlib
import json
import random
import unicodedata
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import lexical, rounding, scalars, vectors
from quillgraph.functions.chunker import WordCounter, chunk_documents, spans


def one(spark, col, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(col.alias("x")).first()["x"]


def column(spark, values, kind, col):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", col.alias("x")).orderBy("i").collect()]


def test_round4_is_pythons_round(spark):
    rng = random.Random(1)
    xs = [rng.random() for _ in range(2000)] + [k / 20000 for k in range(0, 20001, 7)] + [0.00005, 0.00015, 0.12345, 0.00025]
    assert column(spark, xs, "double", rounding.round4(F.col("v"))) == [round(x, 4) for x in xs]


def test_clamp(spark):
    xs = [-1.0, 0.5, 2.0, float("nan"), float("inf"), None]
    assert column(spark, xs, "double", rounding.clamp_weight(F.col("v"))) == [0.0, 0.5, 1.0, 0.0, 0.0, 0.0]


def test_weight_golden(spark):
    got = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (0.333333, 0.5)], "w double, v double").select(rounding.updated_weight(F.col("w"), F.col("v")).alias("x")).collect()
    assert [r.x for r in got] == [0.9, 0.1, 0.35]
    assert column(spark, [-1, 0, 1], "int", rounding.feedback_value(F.col("v"))) == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError):
        rounding.updated_weight(F.lit(1.0), F.lit(1.0), 0)


def test_names(spark):
    names = ["Straße  Café", " ﬁne\u00a0X ", "ABC", None, "   "]
    got = column(spark, names, "string", scalars.canonical_entity_key(F.lit("Org"), F.col("v")))
    fold = lambda s: " ".join(unicodedata.normalize("NFKC", s).split()).casefold()
    assert got == [None if n is None or not fold(n) else "org:" + fold(n) for n in names]
    assert column(spark, ["Works - At!", "__a  b__"], "string", scalars.relation_predicate(F.col("v"))) == ["works_at", "a_b"]
    assert column(spark, ["Works - At!", "__a  b__"], "string", scalars.ascii_predicate(F.col("v"))) == ["works_at", "a_b"]
    assert column(spark, ["Über Straße 9", "日本"], "string", scalars.dataset_slug(F.col("v"))) == ["uber-strae-9", None]


def test_hashes_and_ids(spark):
    ns = "12345678-1234-5678-1234-567812345678"
    assert column(spark, ["a", "é", ""], "string", scalars.uuid5(ns, F.col("v"))) == [str(uuid.uuid5(uuid.UUID(ns), x)) for x in ("a", "é", "")]
    assert one(spark, scalars.chunk_hash(F.col("v")), v=("string", "hé")) == hashlib.sha256("1\x1fhé".encode()).hexdigest()
    payload = {"b": "é", "a": [1, {"z": None}]}
    plain = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert one(spark, scalars.payload_hash(F.col("v")), v=("string", json.dumps(payload))) == hashlib.sha256(plain.encode()).hexdigest()
    env = json.dumps({"definition_id": "d", "input": payload}, sort_keys=True, separators=(",", ":"))
    assert one(spark, scalars.step_input_hash(F.lit("d"), F.col("v")), v=("string", json.dumps(payload))) == hashlib.sha256(env.encode()).hexdigest()
    key = one(spark, scalars.lock_key(F.col("v")), v=("string", ns))
    want = int.from_bytes(hashlib.sha256(scalars.LOCK_PREFIX + uuid.UUID(ns).bytes).digest()[:8], "big") & (2**63 - 1)
    assert key == want and scalars.GLOBAL_LOCK < 0
    a = scalars.config_fingerprint({"url": "https://u:p@h:1/x?k=1", "api_key": "s", "n": 1})
    assert a == scalars.config_fingerprint({"url": "https://h:1/x", "api_key": "t", "n": 1}) != scalars.config_fingerprint({"url": "https://h:1/x", "n": 2})


def test_quote(spark):
    long = "word " * 200
    got = column(spark, ["a \u00a0 b\n c", long, None], "string", scalars.reference_quote(F.col("v")))
    assert got[0] == "a b c" and len(got[1]) == 500 and got[1].endswith("…") and got[2] is None


def test_mention(spark):
    m = scalars.first_mention(F.col("t"), F.lit("Zed"), F.array(F.lit("Bob"), F.lit("Ann")))
    assert tuple(one(spark, m, t=("string", "x Ann Bob"))) == ("Bob", 6, 9)
    assert tuple(one(spark, m, t=("string", "nobody"))) == ("Zed", None, None)


@pytest.mark.parametrize("marker,ok", [
    ({"version": "degree-v1", "feedback_weight": 0.5, "centrality_weight": 1}, True), ({"version": "degree-v1", "feedback_weight": True, "centrality_weight": 0.5}, False),
    ({"version": "degree-v2", "feedback_weight": 0.5, "centrality_weight": 0.5}, False), ({"version": "degree-v1", "feedback_weight": "0.5", "centrality_weight": 0.5}, False),
    ({"version": "degree-v1", "feedback_weight": 1.5, "centrality_weight": 0.5}, False), ({"version": "degree-v1", "feedback_weight": 0.5}, False),
])
def test_importance_marker(spark, marker, ok):
    got = one(spark, scalars.importance_marker(F.col("v")), v=("string", json.dumps({"importance": marker, "other": 1})))
    assert (got is not None) == ok
    assert one(spark, scalars.importance_marker(F.col("v")), v=("string", "not json")) is None


def test_references(spark):
    text = json.dumps({"items": [{"source_id": "s", "chunk_id": "c", "score": 1.0}, {}]})
    assert len(one(spark, scalars.parse_references(F.col("v")), v=("string", text))) == 1
    assert one(spark, scalars.parse_references(F.col("v")), v=("string", "{bad")) == []


def test_lexical(spark):
    docs = ["the quick brown fox", "quick fox, brown the", "a brown quick dog", None, ""]
    v = lexical.to_vector(F.col("v"))
    got = lambda q: [i for i, x in enumerate(column(spark, docs, "string", F.coalesce(lexical.matches(v, lexical.parse_query(q)), F.lit(False)))) if x]
    assert got("quick brown") == [0, 1, 2]
    assert got('"quick brown"') == [0]
    assert got("quick -fox") == [2]
    assert got("dog or the") == [0, 1, 2]
    assert got("") == []
    for q in ("quick brown", '"quick brown"', "quick -fox", "dog or the", "", '"brown fox" or dog'):
        query = lexical.parse_query(q)
        by_tokens = column(spark, docs, "string", F.coalesce(lexical.matches_tokens(lexical.tokens(F.col("v")), query), F.lit(False)))
        assert [i for i, x in enumerate(by_tokens) if x and docs[i]] == got(q)
        ranks = column(spark, docs[:3], "string", lexical.token_rank(lexical.tokens(F.col("v")), query))
        assert ranks == column(spark, docs[:3], "string", lexical.term_rank(v, query))


def test_marks_stay_with_their_letters(spark):
    """Queries are cut as texts are: words with combining marks find themselves."""
    docs = ["हिन्दी text", "e\u0301te\u0301 ici", "ete"]
    v = lexical.to_vector(F.col("v"))
    for i, w in enumerate(d.split()[0] for d in docs):
        assert column(spark, docs, "string", lexical.matches(v, lexical.parse_query(w))) == [k == i for k in range(3)]


def test_vector_positions(spark):
    assert column(spark, ["b a b c a b"], "string", lexical.to_vector(F.col("v"))) == [{"a": [2, 5], "b": [1, 3, 6], "c": [4]}]


def test_cover_density():
    assert lexical.cover_density([[1], [2]]) > lexical.cover_density([[1], [9]]) > 0
    assert lexical.cover_density([[1], []]) == 0
    assert lexical.cover_density([[1, 5], [2, 6]]) > lexical.cover_density([[1], [2]])


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r.x for r in rows.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, None, None, None]
    assert [r.x for r in rows.select(vectors.cosine_to([1.0, 0.0])(F.col("a")).alias("x")).collect()] == [1.0, 1.0, None, None, None]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=300), st.integers(1, 30), st.integers(0, 10), st.integers(1, 10))
def test_chunk_invariants(text, most, overlap, least):
    overlap, least = min(overlap, most - 1), min(least, most)
    got = spans(text, most=most, overlap=overlap, least=least)
    count = WordCounter(text)
    covered = set()
    for a, b in got:
        assert 0 <= a < b <= len(text)
        covered.update(range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert [a for a, _ in got] == sorted({a for a, _ in got})
    for a, b in got:
        assert count(a, b) <= most + 1 or text[b - 1] == "\n"


def test_chunks(spark):
    text = "Intro line.\n\n" + "One sentence repeats here. " * 12 + "\n\nLast part."
    docs = spark.createDataFrame([("d", 1, text), ("e", 1, "short"), ("n", 1, None), ("z", 1, "")], "document_id string, generation int, normalized_text string")
    rows = chunk_documents(docs, most=24, overlap=6, least=4).orderBy("document_id", "ordinal").collect()
    mine = [r for r in rows if r.document_id == "d"]
    assert [r.ordinal for r in mine] == list(range(len(mine))) and len(mine) > 2
    assert all(r.text == text[r.start_char : r.end_char] for r in mine)
    assert any(b.start_char < a.end_char for a, b in zip(mine, mine[1:]))
    assert [r.text for r in rows if r.document_id == "e"] == ["short"]
    assert not [r for r in rows if r.document_id in "nz"]
    again = chunk_documents(docs, most=24, overlap=6, least=4).orderBy("document_id", "ordinal").collect()
    assert [r.chunk_id for r in again] == [r.chunk_id for r in rows]


def test_clock(spark):
    import datetime as dt

    from quillgraph.functions.clock import as_of, timed

    moment = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    assert spark.range(1).select(as_of(moment).cast("long").alias("x")).first().x == int(moment.timestamp())
    took = {}
    with timed(took, "a"):
        pass
    assert took["a"] >= 0

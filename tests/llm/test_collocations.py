"""Phrase mining against plain counting; the perfect hash on its own."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from quillgraph.llm import collocations, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def model(docs, least, percent=80):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for m in range(1, 5):
                for i in range(len(ws) - m + 1):
                    f[lang, tuple(ws[i : i + m])] += 1
    cands = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, ws), a in cands.items():
        if any(k[0] == lang and len(k[1]) > len(ws) and 100 * v >= percent * a and any(k[1][i : i + len(ws)] == ws for i in range(len(k[1]))) for k, v in cands.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out[lang, " ".join(ws)] = (a, f[lang, ws[:k]], f[lang, ws[k:]], n[lang], score)
    return out


def got(df):
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def texts(rng, n):
    out = []
    for _ in range(n):
        words = [rng.choice(["the", "The", "ox", "é", "a.b", "\x1f", "ß", "x_y", "sea-side"]) for _ in range(rng.randrange(40))]
        out.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words), rng.choice(["en", "en", "de", None])))
    return out


@pytest.mark.parametrize("sizes", [{}, {"wave": 40}, {"most_buckets": 64}, {"most_buckets": 64, "wave": 97}])
def test_mining(spark, sizes):
    """Also in many waves, and with so few buckets that they rule out nothing."""
    docs = texts(random.Random(4), 150)
    docs += [(None, "en"), ("", None), (" . ,, \n", "en"), docs[0], docs[0], ("once upon a time " * 20, "xx")]
    df = spark.createDataFrame([(i, t, lang, None, 1) for i, (t, lang) in enumerate(docs)], DOCS).selectExpr("*", "'clash' as phrase", "1 as m").repartition(70)
    want = model(docs, 5)
    assert got(collocations.collocations(df, least=5, **sizes)) == want and want


def test_long_text_and_repeats(spark):
    rng = random.Random(5)
    text = " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(60_000))
    docs = [(text, "en"), ("same words here. " * 4000, "en")]
    df = spark.createDataFrame([(i, t, lang, None, 1) for i, (t, lang) in enumerate(docs)], DOCS)
    assert got(collocations.collocations(df)) == model(docs, 30)


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None)], DOCS)).count() == 0


def test_top_phrases_break_ties_by_count_and_phrase(spark):
    rows = [("en", p, a, 1, 1, 9, s) for p, a, s in [("b", 5, 7), ("a", 5, 7), ("ä", 5, 7), ("z", 6, 7), ("y", 1, 8)]]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    assert [(r["rank"], r.phrase) for r in collocations.top_phrases(df, 4).orderBy("rank").collect()] == [(1, "y"), (2, "z"), (3, "a"), (4, "b")]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    first, second = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
    first[: n // 2] = first[n // 2 : n // 2 * 2]  # half of the keys differ in the second part alone
    h = collocations.PerfectHash(first, second)
    assert sorted(h.find(first, second)) == list(range(n))
    assert (h.find(first, second + np.uint64(1)) == -1).all()
    assert len(h.bits) * 8 <= 5 * n + 64


def test_slots_of_a_run_of_ranges():
    """hashes made range by range number all their keys as one; keys of other ranges have no slot. A wave holds eight times the keys that it held."""
    rng = np.random.default_rng(3)
    first, second = (rng.integers(0, 1 << 64, 40_000, dtype=np.uint64) for _ in range(2))
    at = (first >> np.uint64(64 - collocations.RANGE_BITS)).astype(int)
    some = np.isin(at, [7, 8, 9, 11, 400])
    made = {k: collocations.PerfectHash(first[at == k], second[at == k]) for k in (7, 8, 9, 11, 400)}
    h = collocations.Slots([(k, np.array(p.sizes), p.bits) for k, p in made.items()], np.zeros(some.sum(), np.uint8))
    assert sorted(h.of(first[some], second[some])) == list(range(some.sum()))
    outside = (at < 7) | (at > 400)
    assert (h.of(first[outside], second[outside]) == -1).all() and outside.any()
    assert (collocations.Slots([], np.empty(0, np.uint8)).of(first, second) == -1).all()
    assert collocations.WAVE >= 1 << 24


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = con.sql(queries.oracle_sql()["op12_collocations"])
    cols = sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    rows = queries.op12_collocations(spark, sf_dir)
    assert sorted(rows.columns) == cols
    assert sorted(tuple(r[c] for c in cols) for r in rows.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())

"""The corpus pipeline, stage by stage, and the registered queries with their SQL."""

import collections
import math

import duckdb
import line_model
import pytest
from near_model import near_classes
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import adaptive_quality, piece_codec, queries

DOCS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    one = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    kept = {r.doc_id for r in adaptive_quality.score_documents(docs).where("kept").collect()}
    assert one.columns == DOCS and {r.doc_id for r in one.collect()} == kept
    rows = [x for x in rows if x[0] in kept]
    two = corpus_pipeline.line_dedup(spark, one, sf_dir)
    lines = dict(zip((i for i, _ in rows), line_model.removed(rows), strict=True))
    assert two.columns == DOCS and {r.doc_id: r.text for r in two.collect()} == lines
    three = corpus_pipeline.near_dedup(spark, two, sf_dir)
    want = near_classes(list(lines.items()))
    assert three.columns == DOCS and {r.doc_id for r in three.collect()} == set(want.values())
    four = corpus_pipeline.mix_sources(spark, three, sf_dir)
    n = collections.Counter(r.doc_id for r in four.collect())
    assert four.columns == DOCS and set(n) <= set(want.values()) and max(n.values()) <= 3
    five = corpus_pipeline.encode_pieces(spark, four, sf_dir)
    c = piece_codec.PieceCodec(piece_codec.read_model(queries.public_tokenizers.path(queries.PIECES)))
    assert {r.doc_id: r.n_tokens for r in five.collect()} == {i: len(c.encode(lines[i])) for i in n} and five.count() == sum(n.values())


def test_run(spark, sf_dir):
    assert len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"]


def test_stages_take_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", None, 0), (2, "word " * 80, "en", "a", 1), (2, "word " * 80, "en", "a", 1), (3, " ".join(f"w{i}" for i in range(90)), None, "a", 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit("x"))
    for d in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, sf_dir)
        assert d.count() <= 3

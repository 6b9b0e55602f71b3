"""Every registered query against its DuckDB statement on the smallest tables."""

import math

import duckdb
import pytest

from quillgraph.plans.registry import ORACLES, QUERIES
from quillgraph.sources.fixtures import TABLES

NAMES = sorted(QUERIES)


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "replace") and hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


def test_most_queries_have_an_oracle():
    assert len(ORACLES) > 0.85 * len(QUERIES)

"""Cosine over float arrays. One native expression, and an Arrow form for many rows against one query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """Similarity; null for a null or zero vector or for unequal lengths."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def cosine_to(query: list[float]):
    """A vectorised function column -> similarity to ``query``: one matrix product an Arrow batch."""
    q = np.asarray(query, dtype=np.float64)
    qn = float(np.linalg.norm(q))

    @pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        ok = v.map(lambda x: x is not None and len(x) == len(q)).to_numpy(dtype=bool)
        out = np.full(len(v), np.nan)
        if ok.any() and qn:
            m = np.array(v[ok].tolist(), dtype=np.float64).reshape(int(ok.sum()), len(q))
            n = np.linalg.norm(m, axis=1) * qn
            with np.errstate(invalid="ignore", divide="ignore"):
                out[ok] = np.where(n > 0, m @ q / n, np.nan)
        return pd.Series(out).where(~np.isnan(out), None)

    return run


def valid_components(v: Column) -> Column:
    """No null or non-finite component."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def valid_embedding(v: Column, dimensions: int) -> Column:
    """Right length, no null or non-finite component."""
    return v.isNotNull() & (F.size(v) == dimensions) & valid_components(v)

"""Injected models: protocols, deterministic stand-ins, and the DataFrame functions that call them.

Real clients replace the stand-ins; they are created once a Python worker by
the factory given, and get batches in order.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBED_BATCH = 64
EXTRACTION = (
    "summary string, entities array<struct<local_id:string,name:string,type:string,description:string,aliases:array<string>,confidence:double>>, "
    "relations array<struct<source_local_id:string,target_local_id:string,predicate:string,description:string,confidence:double,evidence:string>>"
)


class EmbeddingClient(Protocol):
    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]: ...


class RagAnswerClient(Protocol):
    def answer(self, query: str, context: str) -> str: ...


class KnowledgeExtractionClient(Protocol):
    def extract(self, text: str) -> dict: ...


class SummaryClient(Protocol):
    def summarize(self, texts: Sequence[str]) -> str: ...


class GraphRecallClient(Protocol):
    def retrieve(self, seeds: DataFrame, limit: int) -> DataFrame: ...


class GraphProjection(Protocol):
    def apply(self, commands: DataFrame) -> None: ...


class HostResolver(Protocol):
    def __call__(self, host: str, port: int) -> list[str]: ...


JitterSource = Callable[[], float]


@lru_cache(maxsize=1 << 17)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class HashEmbedding:
    """Bag-of-words vectors from word hashes; unit length."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            sums = [0] * self.dimensions
            for w, times in Counter(re.findall(r"\w+", t.lower())).items():
                h = _word_hash(w)
                sums[h % self.dimensions] += times if h >> 63 else -times
            v = np.array(sums, dtype=float)
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class CapitalizedExtraction:
    """Entities are capitalised words of a chunk, relations join neighbours in a sentence."""

    def __init__(self, most: int = 8) -> None:
        self.most = most

    def extract(self, text: str) -> dict:
        found: dict[str, None] = {}
        for m in re.finditer(r"\b[^\W\d_a-z]\w{2,}", text):
            if len(found) >= self.most:
                break
            found[m.group()] = None
        ids = {w: f"e{i}" for i, w in enumerate(found)}
        entities = [{"local_id": ids[w], "name": w, "type": "term", "description": "", "aliases": [w], "confidence": 1.0} for w in found]
        relations = []
        for s in re.split(r"(?<=[.!?])\s+", text):
            here = [w for w in found if w in s]
            for a, b in zip(here, here[1:], strict=False):
                relations.append({"source_local_id": ids[a], "target_local_id": ids[b], "predicate": "appears_with", "description": "", "confidence": 0.8, "evidence": s})
        return {"summary": text[:120], "entities": entities, "relations": relations}


class LeadSummary:
    """The first words of each input, numbered."""

    def __init__(self, words: int = 20) -> None:
        self.words = words

    def summarize(self, texts: Sequence[str]) -> str:
        return "\n".join(f"Input {i}: {' '.join(t.split()[: self.words])}" for i, t in enumerate(texts, 1))


class EchoAnswer:
    def answer(self, query: str, context: str) -> str:
        return f"{query}: {context.splitlines()[0] if context else ''}"


def embed(text: Column, make: Callable[[], EmbeddingClient] = HashEmbedding, batch: int = EMBED_BATCH) -> Column:
    """Vectors of a text column, in batches of ``batch``; null text has a null vector."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for s in parts:
            got: list = [None] * len(s)
            at = [i for i, x in enumerate(s) if x is not None]
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                vectors = client.embed_texts([s.iloc[i] for i in part])
                if len(vectors) != len(part):
                    raise ValueError("the provider returned another number of vectors")
                for i, v in zip(part, vectors, strict=True):
                    got[i] = v
            yield pd.Series(got)

    return run(text)


def extract(text: Column, make: Callable[[], KnowledgeExtractionClient] = CapitalizedExtraction) -> Column:
    """An extraction struct for each chunk; one repair attempt, then null."""

    @F.pandas_udf(EXTRACTION)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make()
        for s in parts:
            rows = []
            for t in s:
                for _ in range(2):
                    try:
                        rows.append(client.extract(t or ""))
                        break
                    except ValueError:
                        continue
                else:
                    rows.append({"summary": None, "entities": None, "relations": None})
            yield pd.DataFrame(rows, columns=["summary", "entities", "relations"])

    return run(text)


def summarize(texts: Column, make: Callable[[], SummaryClient] = LeadSummary) -> Column:
    """Summary of an ordered array of texts."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        client = make()
        return s.map(lambda x: None if x is None or not len(x) else client.summarize(list(x)))

    return run(texts)


def answer(query: Column, context: Column, make: Callable[[], RagAnswerClient] = EchoAnswer) -> Column:
    """A29."""

    @F.pandas_udf("string")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        client = make()
        return pd.Series([client.answer(a, b) for a, b in zip(q, c, strict=True)])

    return run(query, context)

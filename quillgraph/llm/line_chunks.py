"""Line dedup by content-defined chunks.

A text is split at newlines. A rolling hash over the hashes of the last
``WINDOW`` lines decides whether a chunk ends after a line, so boundaries move
with the content and an insertion disturbs only its surroundings. A chunk of
two or more lines with words that occurs more than once in the corpus stays at
its first place (smallest doc_id, then key, then position) and goes everywhere
else. Chunks are matched by hash and then grouped by their bytes, so chunks that
only share a hash leave each other alone and both find their own first place.
Hashes with more than a thousandth of all repeated chunks are fewer than a
thousand; they are broadcast and their rows are salted.

Null text is empty. A null doc_id sorts last. Rows with equal doc_id and text
count as one document and get the same result. Texts of one line never change.
Empty tables give no rows.
Further columns are kept as they are; names that start with ``_ld_`` are ours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, row_key, text_of, written

WINDOW, MEAN, LEAST, MOST = 2, 2, 2, 64
#: A key with more than 1 / HOT of the repeated chunks is hot; its rows are dealt over SALTS parts of a join.
HOT, SALTS = 1000, 64
#: Fixed odd multipliers of the rolling hash, one for each line of the window.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def boundaries(lines: list[bytes]) -> list[int]:
    """Ends of the chunks of ``lines``, increasing, the last being len(lines)."""
    n = len(lines)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), dtype=np.uint64, count=n)
    rolled = h * FACTORS[0]
    rolled[1:] += h[:-1] * FACTORS[1]
    cut = np.flatnonzero(mixed(rolled) % np.uint64(MEAN) == 0) + 1
    ends, start = [], 0
    for c in [*cut.tolist(), n]:
        while c - start > MOST:
            start += MOST
            ends.append(start)
        if c - start >= LEAST or c == n and c > start:
            ends.append(c)
            start = c
    return ends


def chunks(text: bytes):
    """(index, number of lines, bytes) of each chunk; only chunks of two or more lines with words are named."""
    lines = text.split(b"\n")
    if len(lines) < LEAST:
        return lines, []
    out, start = [], 0
    for i, end in enumerate(boundaries(lines)):
        if end - start >= LEAST and sum(1 for x in lines[start:end] if x.split(None, 1)) >= LEAST:
            out.append((i, start, end))
        start = end
    return lines, out


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def _occurrences(batches):
    for b in batches:
        row, idx, h = [], [], []
        for i, t in enumerate(_texts(b, "_ld_text")):
            lines, found = chunks(t)
            for k, s, e in found:
                row.append(i)
                idx.append(k)
                h.append(xxhash.xxh3_64_intdigest(b"\n".join(lines[s:e])))
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [b.column("_ld_id").take(at), b.column("_ld_key").take(at), pa.array(idx, pa.int32()), pa.array(np.array(h, dtype=np.uint64).view(np.int64))],
            names=["_ld_id", "_ld_key", "idx", "h"],
        )


def _candidate_texts(batches):
    for b in batches:
        row, idx, h, text = [], [], [], []
        for i, (t, wanted) in enumerate(zip(_texts(b, "_ld_text"), b.column("cand").to_pylist(), strict=True)):
            wanted = set(wanted)
            lines, found = chunks(t)
            for k, s, e in found:
                if k in wanted:
                    row.append(i)
                    idx.append(k)
                    text.append(body := b"\n".join(lines[s:e]))
                    h.append(xxhash.xxh3_64_intdigest(body))
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [b.column("_ld_id").take(at), b.column("_ld_key").take(at), pa.array(idx, pa.int32()), pa.array(np.array(h, dtype=np.uint64).view(np.int64)), pa.array(text, pa.binary())],
            names=["_ld_id", "_ld_key", "idx", "h", "body"],
        )


def _applied(batches):
    for b in batches:
        texts, total, gone_lines, out = _texts(b, "_ld_text"), [], [], []
        for t, gone in zip(texts, b.column("gone").to_pylist(), strict=True):
            lines = t.split(b"\n")
            total.append(len(lines))
            if not gone:
                gone_lines.append(0)
                out.append(t)
                continue
            gone, _, found = set(gone), *chunks(t)
            drop = set()
            for k, s, e in found:
                if k in gone:
                    drop.update(range(s, e))
            gone_lines.append(len(drop))
            out.append(b"\n".join(x for i, x in enumerate(lines) if i not in drop))
        names = [n for n in b.schema.names if n not in ("_ld_text", "gone")]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(n) for n in names), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone_lines, pa.int64())],
            names=[*names, "_ld_text", "_ld_n_lines", "_ld_n_removed"],
        )


def removals(docs: DataFrame) -> DataFrame:
    """(_ld_key, gone): for each document with repeated chunks, the indexes of the chunks that go.

    ``docs``: _ld_id, _ld_key, _ld_text.
    """
    occ = written(docs.mapInArrow(_occurrences, "_ld_id long, _ld_key string, idx int, h long"), "line-chunks")
    # A table of its own: the share of each key is known before any join deals rows by it.
    repeated = written(occ.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "line-chunks-repeated")
    total = repeated.agg(F.sum("n")).scalar()
    hot = repeated.where(F.col("n") * HOT > total).select("h")  # fewer than HOT keys
    cand = _met(occ, repeated.select("h"), ["h"], hot).groupBy("_ld_key").agg(F.collect_set("idx").alias("cand"))
    bodies = written(docs.join(cand, "_ld_key").mapInArrow(_candidate_texts, "_ld_id long, _ld_key string, idx int, h long, body binary"), "line-chunk-bodies", free=True)
    place = F.struct(F.col("_ld_id").isNull().alias("n"), F.col("_ld_id").alias("id"), F.col("_ld_key").alias("key"), F.col("idx").alias("idx"))
    firsts = bodies.groupBy("h", "body").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    firsts = written(firsts.select("h", "body", "first"), "line-chunk-firsts")
    gone = _met(bodies, firsts, ["h", "body"], hot).where(place != F.col("first"))
    return gone.groupBy("_ld_key").agg(F.collect_set("idx").alias("gone"))


def _met(rows: DataFrame, keys: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``keys``; rows of a hot ``h`` are dealt over ``SALTS`` parts, to each of which its keys are copied."""
    marked = F.broadcast(hot.withColumn("_ld_hot", F.lit(True)))
    is_hot = F.col("_ld_hot").isNotNull()
    salted = rows.join(marked, "h", "left").withColumn("_ld_salt", F.when(is_hot, F.pmod(F.xxhash64("_ld_key", "idx"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_ld_hot")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = keys.join(marked, "h", "left").withColumn("_ld_salt", F.explode(salts)).drop("_ld_hot")
    return salted.join(copied, [*on, "_ld_salt"]).drop("_ld_salt")


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", counts: bool = False) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text`` (null text comes back empty); with ``counts`` also n_lines and n_removed (long)."""
    keyed = docs.withColumns({"_ld_key": row_key(doc_id, text), "_ld_text": text_of(text)})
    gone = removals(keyed.select(F.col(doc_id).cast("long").alias("_ld_id"), "_ld_key", "_ld_text"))
    names = [c for c in docs.columns if c != text]
    ours = {c: f"_ld_c{i}" for i, c in enumerate(names)}
    left = keyed.select("_ld_key", "_ld_text", *(F.col(c).alias(ours[c]) for c in names)).join(gone, "_ld_key", "left").drop("_ld_key")
    kept = [f for f in left.schema.fields if f.name not in ("_ld_text", "gone")]
    out = T.StructType([*kept, T.StructField("_ld_text", T.StringType()), T.StructField("_ld_n_lines", T.LongType()), T.StructField("_ld_n_removed", T.LongType())])
    done = left.select(*(f.name for f in kept), "_ld_text", "gone").mapInArrow(_applied, out)
    order = [F.col("_ld_text").alias(text) if c == text else F.col(ours[c]).alias(c) for c in docs.columns]
    return done.select(*order, *([F.col("_ld_n_lines").alias("n_lines"), F.col("_ld_n_removed").alias("n_removed")] if counts else []))

"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a row's hash. It starts as one
bucket; a bucket whose bytes pass the limit is split on its next bit, the
others stay, until every shard fits. Sums for all prefixes of one span of bits
come from a single aggregation of the cells of that span; only cells that are
still too large after it enter the next span.

A single row larger than the limit gets a shard of its own, which nothing can
split. Null text has 0 bytes. Repeated rows are told apart by their ordinal, so
copies of one row spread over shards too. Empty input gives no rows. A shard is
named by its bits; the undivided table is the shard "" (no bits). A null doc_id
is a value like others. Further columns are not read by ``assign_shards`` and
kept by ``write_shards``; names that start with ``_xh_`` are ours.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_copies, row_key, text_of, written

BITS = 60  # of the hash; fifteen hex digits


def hash_units(docs: DataFrame) -> DataFrame:
    """(doc_id, key, ordinal, n_bytes, h): h is a string of 60 bits."""
    units = docs.select("doc_id", row_key("doc_id", "text").alias("key"), F.octet_length(text_of("text")).cast("long").alias("n_bytes"))
    units = units.groupBy("doc_id", "key", "n_bytes").agg(F.count("*").alias("n"))
    units = units.select("doc_id", "key", "n_bytes", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("ordinal"))
    digest = F.md5(F.concat_ws(":", "key", F.col("ordinal").cast("string")))
    bits = F.lpad(F.conv(F.substring(digest, 1, BITS // 4), 16, 2), BITS, "0")
    return units.select("doc_id", "key", "ordinal", "n_bytes", bits.alias("h"))


def directory(units: DataFrame, limit: int) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows) of the leaves. ``units``: h, n_bytes."""
    total, rows = units.agg(F.sum("n_bytes"), F.count("*")).first()
    span = min(BITS, max(4, math.ceil(math.log2(max(1, (total or 0) / limit))) + 3))
    leaves, base, rest = None, 0, units.select("h", "n_bytes")
    # A unit that is alone in its bucket ends the splitting whatever its size.
    while True:
        top = min(BITS, base + span)
        cells = rest.groupBy(F.substring("h", 1, top).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("r"))
        sums = (
            cells.select(F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"), "cell", "b", "r")
            .select(F.expr("substring(cell, 1, depth)").alias("shard"), "depth", "b", "r")
            .groupBy("shard", "depth").agg(F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows"))
        )
        sums = written(sums, "extendible-sums")
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)
        split = sums.where(~fits).select(F.col("shard").alias("parent"))
        parent = F.expr("substring(shard, 1, depth - 1)")
        found = sums.where(fits & (F.col("depth") > base)).join(split, parent == F.col("parent"), "left_semi")
        if base == 0:
            found = found.unionByName(sums.where(fits & (F.col("depth") == 0)))
        leaves = found if leaves is None else leaves.unionByName(found)
        over = sums.where(~fits & (F.col("depth") == top)).select("shard")
        if top == BITS or over.isEmpty():
            if top == BITS:
                leaves = leaves.unionByName(sums.where(~fits & (F.col("depth") == top)))
            return leaves.select("shard", "depth", "shard_bytes", "shard_rows")
        rest = written(rest.join(over, F.substring("h", 1, top) == F.col("shard"), "left_semi"), "extendible-rest")
        base = top


def assign_shards(docs: DataFrame, *, limit: int) -> DataFrame:
    """One row a document: doc_id, key, ordinal, n_bytes, shard, depth, shard_bytes, shard_rows."""
    units = written(hash_units(docs), "extendible-units")
    leaves = written(directory(units, limit), "extendible-directory")
    deepest = [r[0] for r in leaves.select("depth").distinct().orderBy("depth").collect()]  # at most 61 numbers
    # A unit carries one probe for each depth in use; exactly one of them names a leaf.
    probes = units.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in deepest)) if deepest else F.array(F.lit(0))))
    probes = probes.withColumn("shard", F.expr("substring(h, 1, depth)"))
    return probes.join(leaves, ["shard", "depth"]).select("doc_id", "key", "ordinal", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, path: str, *, limit: int) -> DataFrame:
    """Write ``docs`` with a folder a shard and return the assignment.

    Rows of equal doc_id and text are numbered and each goes to the shard of
    its number, so rows that differ in further columns keep them.
    """
    placed = written(assign_shards(docs, limit=limit), "extendible-placed")
    many = placed.where("ordinal = 2").select(F.col("key").alias("_xh_key"))
    keyed = docs.withColumn("_xh_key", row_key("doc_id", "text"))
    shard = F.concat(F.lit("s"), "shard").alias("_xh_shard")
    if many.isEmpty():
        out = keyed.join(placed.select(F.col("key").alias("_xh_key"), shard), "_xh_key")
    else:
        once = keyed.join(many, "_xh_key", "left_anti").withColumn("_xh_ordinal", F.lit(1).cast("long"))
        copies = number_copies(keyed.join(many, "_xh_key", "left_semi"), "_xh_key", "_xh_ordinal")
        by = placed.select(F.col("key").alias("_xh_key"), F.col("ordinal").alias("_xh_ordinal"), shard)
        out = once.unionByName(copies).join(by, ["_xh_key", "_xh_ordinal"]).drop("_xh_ordinal")
    out.drop("_xh_key").repartition("_xh_shard").write.partitionBy("_xh_shard").parquet(path)
    return placed

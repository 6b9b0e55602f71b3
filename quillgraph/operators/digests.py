"""Reconciliation by digests; only what differs is read.

Identities are cut into ``RANGES`` ranges by hash, and a digest of a range is
the count, the sum and the exclusive or of two more hashes of its identities:
the same in any order, so it can be summed over files and ranges. Two sides
compare the digests of 32 groups of ranges first and those of the single
ranges inside groups that differ; identities are read from the folders of
these groups alone, and joined in the ranges that differ alone. Sides in sync
read no identity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shares

RANGES, GROUPS = 1024, 32
KEY = ("dataset_id", "kind")


def range_of() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(RANGES)).cast("int")


def summed(rows: DataFrame, *by: str) -> DataFrame:
    """Digests of digests: they add up."""
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"))


@dataclass
class IdentityStore:
    """Identities (dataset_id, kind, id) of one side, in folders by group of ranges, with their digests."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, identities: DataFrame, path: str) -> IdentityStore:
        rows = identities.select("dataset_id", "kind", "id").withColumn("range", range_of())
        rows = rows.withColumn("group", (F.col("range") / (RANGES // GROUPS)).cast("int"))
        # Dealt by range, equal identities are in one task already; the digests are made from what is stored.
        rows.repartition(min(RANGES, shares(identities.sparkSession)), "range").distinct().sortWithinPartitions("group", "range").write.partitionBy("group").parquet(f"{path}/ids")
        own = cls(spark=identities.sparkSession, path=path).ids().select("dataset_id", "kind", "range", "group", F.lit(1).cast("long").alias("n"), F.xxhash64(F.lit("sum"), "id").cast("decimal(20,0)").alias("s"), F.xxhash64(F.lit("xor"), "id").alias("x"))
        own = own.groupBy(*KEY, "range", "group").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"), F.bit_xor("x").alias("x"))
        own.repartition(GROUPS, "group").sortWithinPartitions("range").write.partitionBy("group").parquet(f"{path}/digests")
        groups = cls(spark=identities.sparkSession, path=path)
        summed(groups.digests(), *KEY, "group").coalesce(1).write.parquet(f"{path}/groups")
        return groups

    SCHEMA = "dataset_id string, kind string, range int, n long, s decimal(38,0), x long, group int"

    def digests(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/digests")

    def groups(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/groups")

    def ids(self) -> DataFrame:
        return self.spark.read.schema("dataset_id string, kind string, id string, range int, group int").parquet(f"{self.path}/ids")


def differing(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Keys whose digests are not equal on both sides."""
    other = b.select(*(F.col(c).alias(f"_{c}") for c in by), F.struct("n", F.col("s").cast("decimal(38,0)").alias("s"), "x").alias("theirs"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    rows = a.select(*by, F.struct("n", F.col("s").cast("decimal(38,0)").alias("s"), "x").alias("ours")).join(other, on, "full_outer")
    return rows.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select(*(F.coalesce(c, f"_{c}").alias(c) for c in by))


def reconciled(expected: IdentityStore, actual: IdentityStore) -> DataFrame:
    """(dataset_id, kind, expected, actual, missing, extra), as a full outer join of all identities would give it."""
    groups = sorted(r[0] for r in differing(expected.groups(), actual.groups(), *KEY, "group").select("group").distinct().collect())  # at most GROUPS numbers
    inside = F.col("group").isin(groups) if groups else F.lit(False)
    ranges = differing(expected.digests().where(inside), actual.digests().where(inside), *KEY, "range")
    only = lambda side: side.ids().where(inside).join(ranges.select("dataset_id", "kind", "range"), [*KEY, "range"], "left_semi").select(*KEY, "id")
    rows = only(expected).withColumn("_a", F.lit(1)).join(only(actual).withColumn("_b", F.lit(1)), [*KEY, "id"], "full_outer")
    off = rows.groupBy(*KEY).agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"))
    totals = expected.groups().select(*KEY, F.col("n").alias("e"), F.lit(0).cast("long").alias("a")).unionByName(actual.groups().select(*KEY, F.lit(0).cast("long").alias("e"), F.col("n").alias("a")))
    totals = totals.groupBy(*KEY).agg(F.sum("e").alias("expected"), F.sum("a").alias("actual"))
    return totals.join(off, list(KEY), "left").select(*KEY, "expected", "actual", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("extra", F.lit(0)).alias("extra"))

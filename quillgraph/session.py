"""Session defaults the engine is built for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: UTC because stored timestamps have no zone; adaptive execution for skew and small partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "quillgraph", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Bytes of input, as stored, for each partition that a shuffle begins with, and of shuffled rows that adaptive execution puts into one task; rows take some twenty times as much in memory.
PART, SHARE = 4 << 20, "8m"


def dealt(spark: SparkSession, n_bytes: int) -> None:
    """Let shuffles begin with partitions in proportion to an input of ``n_bytes``, so that no task's share grows with it; adaptive execution puts small ones together again."""
    first, share = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(first, str(max(least, int(spark.conf.get(first, None) or 0), n_bytes // PART)))
    named, size = spark.conf.get(share, None), spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if named is None or size(named) > size(SHARE):  # a larger share would let a task's memory grow with the input up to it
        spark.conf.set(share, SHARE)


def shares(spark: SparkSession) -> int:
    """The partitions that a shuffle begins with: for rows that shrink so much when they are stored that a task's share by bytes would be many of them."""
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    """The session's settings ``own`` within, and as they were after it."""
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy(spark: SparkSession, multiple: int = 1):
    """Queries begun within drop their shuffle files when they end, not when the driver next collects garbage, and read at most 64 MB of files in a task, whose memory so does not grow with the input; their shuffles begin with a multiple of ``multiple`` partitions."""
    first = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(-(-shares(spark) // multiple) * multiple)} if multiple > 1 else {}
    read, size = "spark.sql.files.maxPartitionBytes", spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", read: str(min(size(spark.conf.get(read)), 64 << 20))} | first)


def sifted(spark: SparkSession, n: int):
    """A join within, with a filtered side of ``n`` keys, deals only rows of its other side that pass a Bloom filter of the first of these keys (at most 16 MB, sent to all tasks)."""
    own = {"applicationSideScanSizeThreshold": 0, "creationSideThreshold": 1 << 62, "expectedNumItems": max(n, 1), "maxNumItems": max(n, 4_000_000), "numBits": min(8 * n, 1 << 27) + 64, "maxNumBits": 1 << 28}
    return settings(spark, {f"spark.sql.optimizer.runtime.bloomFilter.{k}": str(v) for k, v in own.items()} | {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtimeFilter.number.threshold": "1"})


def scratch(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; a folder of our own only in local mode, where none is named."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints/quillgraph")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for derived tables: the one for checkpoints."""
    scratch(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")

"""Shared pieces of the training-data operators: words, keys, stable word hashes and scratch tables."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word, as every contract of this package defines it (Java, RE2 and Python read it alike).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def text_of(col: str | Column) -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(col: str | Column) -> Column:
    return F.regexp_extract_all(text_of(col), F.lit(WORD), F.lit(0))


def row_key(*cols: str | Column) -> Column:
    """128 bits, as hex, that name a row by its id and its content; equal rows share it."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.md5(F.concat_ws("\u0001", *parts))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    own = "/tmp/checkpoints/quillgraph"
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, name: str, *, free: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and lost executors lose nothing.

    Shuffle files behind a table are garbage once it is written, but Spark
    deletes them only when the driver's garbage is collected; ``free`` asks for
    that after steps that shuffle whole texts.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if free:
        gc.collect()
        for _ in range(2):  # the first makes references of the finished job weak, the second finds them
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def number_copies(rows: DataFrame, key: str, as_: str) -> DataFrame:
    """``rows`` with the number of each among those of equal ``key``, from 1.

    Rows are dealt by ranges of the key and all their columns, so that copies
    of a hot key lie in many tasks; what came before in other tasks is a row a key and task.
    """
    part, place = f"{as_}_part", f"{as_}_place"
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))
    dealt = rows.withColumn(as_, whole).repartitionByRange(partitions(rows.sparkSession), key, as_).sortWithinPartitions(key, as_)
    dealt = written(dealt.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()).drop(as_), "copies")
    firsts = dealt.groupBy(key, part).agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select(key, part, (before - F.col("_first") + 1).alias("_shift"))
    return dealt.join(firsts, [key, part]).withColumn(as_, F.col(place) + F.col("_shift")).drop(part, place, "_shift")


class WordHashes(dict):
    """word (bytes) -> row of two 64-bit hashes; the memo is emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 150_000) -> None:
        super().__init__()
        self.limit = limit
        self.first = np.empty(limit + 1, dtype=np.uint64)
        self.second = np.empty(limit + 1, dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        both = xxhash.xxh3_128_intdigest(word)
        self.first[at] = both & 0xFFFFFFFFFFFFFFFF
        self.second[at] = both >> 64
        self[word] = at
        return at

    def of(self, tokens: list[bytes], wide: bool = False):
        """Hashes of ``tokens`` in order: one array, or two of them (``wide``). A longer text grows the memo for itself."""
        if len(self) + len(tokens) > self.limit:
            self.clear()
            if len(tokens) > self.limit:
                self.limit = 2 * len(tokens)
                self.first = np.empty(self.limit + 1, dtype=np.uint64)
                self.second = np.empty(self.limit + 1, dtype=np.uint64)
        at = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        return (self.first[at], self.second[at]) if wide else self.first[at]


_ODD = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values (uint64, wrapping): log2(width) passes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    done, out, power, block, base = 0, None, 1, h, int(_ODD)
    size = 1
    mask = (1 << 64) - 1
    while True:
        if width & size:
            part = block[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, size, 1 << 64)) + part
            done += size
        if size * 2 > width:
            break
        block = block[: len(block) - size] * np.uint64(pow(base, size, 1 << 64) & mask) + block[size:]
        size *= 2
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""Snapshots of tables on any Hadoop file system: write all, then publish by one marker.

Every mutating plan is a pure function from tables to tables; a snapshot makes
its result the current state. Readers see the newest snapshot that has its
marker, so a half-written one is never seen and a failed run costs nothing.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_dir

MARKER = "_PUBLISHED"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def files_key(spark: SparkSession, *paths: str) -> str:
    """A name for the present content of files and folders: paths, lengths and times of change."""
    seen = []
    for path in paths:
        p, fs = _fs(spark, path)
        for s in fs.globStatus(p):
            found = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
            seen += [f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in found]
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def derived(spark: SparkSession, name: str, inputs: list[str], build) -> str:
    """The folder of what ``build(folder)`` writes for the files ``inputs``; built once for their present content.

    It is built aside and renamed when it is complete, so a failed or a second
    build leaves nothing half-written.
    """
    final = f"{scratch_dir(spark)}/derived/{name}-{files_key(spark, *inputs)}"
    p, fs = _fs(spark, final)
    if not fs.exists(p):
        aside = f"{final}-{uuid.uuid4().hex}"
        build(aside)
        a, _ = _fs(spark, aside)
        if fs.exists(p) or not fs.rename(a, p):
            fs.delete(a, True)
    return final


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published snapshots, oldest first."""
    p, fs = _fs(spark, root)
    if not fs.exists(p):
        return []
    found = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("snapshot=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), MARKER)):
            found.append(int(name[9:]))
    return sorted(found)


def publish(tables: dict[str, DataFrame], root: str, *, partition_by: dict[str, str] | None = None) -> int:
    """Write ``tables`` as the next snapshot and publish it; returns its number. There is one writer at a time."""
    spark = next(iter(tables.values())).sparkSession
    number = (versions(spark, root) or [0])[-1] + 1
    folder = f"{root}/snapshot={number}"
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        by = (partition_by or {}).get(name)
        (writer.partitionBy(by) if by else writer).parquet(f"{folder}/{name}")
    p, fs = _fs(spark, f"{folder}/{MARKER}")
    fs.create(p, True).close()
    return number


def current(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """Tables of the newest published snapshot, or of a given one."""
    have = versions(spark, root)
    if not have or (version is not None and version not in have):
        raise LookupError("no such snapshot")
    folder = f"{root}/snapshot={version or have[-1]}"
    p, fs = _fs(spark, folder)
    return {s.getPath().getName(): spark.read.parquet(s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory()}

"""Containment in JSON metadata by a stored index of paths and values.

Every object, array and scalar of a row's metadata gives a key: the hash of
its path (names of members, one mark for all places of an array) and of its
kind and value. Metadata can contain a wanted object only if the row has all
keys of the wanted one, so these are read, counted by row and intersected; the
rows left over are compared exactly, which also settles arrays of objects and
hashes that meet.

Rows of the index are dealt by ranges of (key, id) and sorted: the filter on
keys is pushed into the scan and leaves out files and row groups, and a key
that a third of all rows share lies in many files.

Null, malformed or too deeply nested metadata contains nothing; ``{}`` is in
every object; an empty table gives an empty index; rows may repeat and have
further columns. Ids are compared as they are; rows without one are not found.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scope import contains_json

ELEMENT = 0  # the step from an array to any of its elements; members are strings


def _label(value) -> str:
    """Kind and value; equal numbers have equal hashes, whatever their form."""
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    if value is None or isinstance(value, bool):
        return str(value)
    return f"text {value}" if isinstance(value, str) else f"number {hash(value)}"


def keys(value) -> set[int]:
    """The keys of a parsed JSON value."""
    out, todo = set(), [((), value)]
    while todo:
        path, v = todo.pop()
        named = f"{json.dumps(path)} {_label(v)}".encode("utf-8", "surrogatepass")
        out.add(xxhash.xxh3_64_intdigest(named) - (1 << 63))
        if isinstance(v, dict):
            todo += [((*path, k), x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [((*path, ELEMENT), x) for x in v]
    return out


def _keys_of_text(text: str | None) -> list[int]:
    try:
        return [] if text is None else list(keys(json.loads(text)))
    except (ValueError, RecursionError):
        return []


@dataclass
class MetadataIndex:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, id_col: str = "source_id", metadata: str = "metadata") -> MetadataIndex:
        """Write the index of ``metadata`` (JSON text) by ``id_col``; one shuffle for the distinct (key, id), one by their ranges."""
        spark = rows.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        given = rows.select(F.col(id_col).alias("id"), F.col(metadata).alias("metadata")).where("id is not null")

        def run(batches):
            for whole in batches:
                for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                    found = [_keys_of_text(t) for t in b.column("metadata").to_pylist()]
                    at = pa.array([i for i, ks in enumerate(found) for _ in ks], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array([k for ks in found for k in ks], pa.int64())], names=["id", "key"])

        ddl = f"id {given.schema['id'].dataType.simpleString()}, key long"
        posts = given.mapInArrow(run, ddl).dropDuplicates(["key", "id"])
        posts.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").write.parquet(f"{path}/postings")
        return cls(spark, path)

    def candidates(self, wanted: dict) -> DataFrame:
        """(id, least_key) of the rows that have all keys of ``wanted``, each once; a count by id, with no task that gathers a key."""
        some = sorted(keys(wanted))
        posts = self.spark.read.parquet(f"{self.path}/postings").where(F.col("key").isin(some))
        return posts.groupBy("id").agg(F.count("*").alias("n"), F.min("key").alias("least_key")).where(F.col("n") == len(some)).select("id", "least_key")

    def containing(self, rows: DataFrame, wanted: dict, *, id_col: str = "source_id", metadata: str = "metadata") -> DataFrame:
        """``rows`` whose metadata contains ``wanted``: those the index names, compared exactly.

        The comparison reads a column of the index as well, or it would be
        pushed below the join and parse all rows. ``_index_`` is a reserved prefix.
        """
        named = self.candidates(wanted).toDF("_index_id", "_index_key")
        both = rows.join(named, F.col(f"`{id_col}`") == F.col("_index_id"))
        text = F.when(F.col("_index_key") == min(keys(wanted)), F.col(f"`{metadata}`"))
        return both.where(contains_json(text, wanted)).select(*(f"`{c}`" for c in rows.columns))

"""Rebuild the projection of one dataset or of all from a snapshot.

    python -m quillgraph.plans.rebuild ROOT OUT --dataset NAME
    python -m quillgraph.plans.rebuild ROOT OUT --all --confirm
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import projection
from ..session import session
from ..sources import store


def rebuild(spark: SparkSession, root: str, out: str, dataset: str | None) -> DataFrame:
    """Write the projections and return their counts; one dataset replaces its own partitions only."""
    t = store.current(spark, root)
    sets = t["datasets"] if dataset is None else t["datasets"].where(F.col("slug") == dataset)
    if sets.where("status = 'active'").isEmpty():
        raise LookupError("no active dataset")
    rows = projection.identities(projection.rebuilt(sets, t["entities"], t["chunks"], t["mentions"], t["relations"]))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static" if dataset is None else "dynamic").partitionBy("dataset_id").parquet(out)
    done = spark.read.parquet(out)
    return done.groupBy("dataset_id", "kind").agg(F.count("*").alias("n")).orderBy("dataset_id", "kind")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root")
    p.add_argument("out")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--dataset")
    which.add_argument("--all", action="store_true")
    p.add_argument("--confirm", action="store_true")
    a = p.parse_args(args)
    if a.all and not a.confirm:
        p.error("--all needs --confirm")
    for r in rebuild(session("rebuild"), a.root, a.out, a.dataset).collect():
        print(r.dataset_id, r.kind, r.n)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

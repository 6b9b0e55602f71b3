"""A sequence of steps whose results are kept by the hash of their input.

A step runs if no finished result of the same definition and input exists; a
changed definition, parameter or upstream step changes the hash, so exactly what
depends on the change runs again. Results are tables in a shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import compact_json


@dataclass(frozen=True)
class Step:
    """``execute(inputs by name, params) -> DataFrame``; ``needs`` are earlier steps or given inputs."""

    name: str
    execute: Callable[[dict[str, DataFrame], dict], DataFrame]
    needs: tuple[str, ...] = ()
    version: str = "1"
    params: dict = field(default_factory=dict)


def checked(steps: list[Step], given: set[str]) -> None:
    seen = set(given)
    for s in steps:
        if s.name in seen:
            raise ValueError(f"two steps or inputs are named {s.name}")
        if missing := set(s.needs) - seen:
            raise ValueError(f"{s.name} needs {sorted(missing)}, which no earlier step makes")
        seen.add(s.name)


def input_hash(step: Step, upstream: dict[str, str]) -> str:
    body = {"definition_id": f"{step.name}:{step.version}", "input": {"params": step.params, "needs": {n: upstream[n] for n in step.needs}}}
    return hashlib.sha256(compact_json(body, ascii_only=True).encode()).hexdigest()


def execute(spark: SparkSession, steps: list[Step], inputs: dict[str, DataFrame], versions: dict[str, str], root: str, *, cancelled: Callable[[], bool] = lambda: False) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables, outcome of each step: ran, skipped or cancelled). ``versions`` names the state of each input.

    Cancellation is looked at between steps only (T17).
    """
    checked(steps, set(inputs))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    tables, hashes, outcome = dict(inputs), dict(versions), {}
    for s in steps:
        if cancelled():
            outcome[s.name] = "cancelled"
            continue
        if any(outcome.get(n) == "cancelled" for n in s.needs):
            outcome[s.name] = "cancelled"
            continue
        hashes[s.name] = input_hash(s, hashes)
        path = f"{root}/{s.name}/{hashes[s.name]}"
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if done.getFileSystem(conf).exists(done):
            outcome[s.name] = "skipped"
        else:
            s.execute({n: tables[n] for n in s.needs}, s.params).write.mode("overwrite").parquet(path)
            outcome[s.name] = "ran"
        tables[s.name] = spark.read.parquet(path)
    return tables, outcome

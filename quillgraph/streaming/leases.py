"""Leases as keyed state with timers.

Each command of the outbox is a key; its state lives in the RocksDB store of
the stream: pending, leased (attempt, worker, when the lease ends), done or
failed. A claim is granted where the command is pending or its lease has
ended, and sets a timer; when the watermark passes it, the lease is over and
the command is pending again, without anybody asking. Heartbeats move the
timer. Results count only from the worker and attempt that hold the lease: late
and repeated ones, and those of a lease that has ended, are refused. A restart
goes on from the checkpoint with all leases and timers.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENT = "command_id string, at timestamp, kind string, worker_id string, attempt int"
STATE = "status string, attempt int, worker_id string, ends long"
OUT = "command_id string, at timestamp, outcome string, status string, worker_id string, attempt int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FINAL = ("done", "failed")


def decide(state: tuple, kind: str, worker, attempt, at: int, lease_ms: int) -> tuple[tuple, str]:
    """The state (status, attempt, worker, ends) after an event at ``at`` (milliseconds), and what became of it."""
    status, have, who, ends = state
    if status == "leased" and ends <= at:  # the timer may come later than the event
        status, who, ends = "pending", None, 0
    if kind == "submit":
        return ((status or "pending"), have or 0, who, ends or 0), "repeated" if status else "submitted"
    if kind == "claim" and status == "pending":
        return ("leased", have + 1, worker, at + lease_ms), "granted"
    own = status == "leased" and worker == who and attempt == have
    if kind == "beat" and own:
        return (status, have, who, at + lease_ms), "extended"
    if kind in FINAL and own:
        return (kind, have, worker, 0), kind
    return (status, have, who, ends), "refused"


class Leases(StatefulProcessor):
    def __init__(self, lease_ms: int) -> None:
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", STATE)

    def handleInputRows(self, key, rows, timerValues):
        before = tuple(self.state.get()) if self.state.exists() else (None, 0, None, 0)
        now, out = before, []
        events = pd.concat(list(rows))
        events["order"] = events["kind"].map({"submit": 0}).fillna(1)
        for r in events.sort_values(["at", "order", "kind", "worker_id"], kind="stable").itertuples(index=False):
            attempt = None if pd.isna(r.attempt) else int(r.attempt)
            worker = None if pd.isna(r.worker_id) else r.worker_id
            now, outcome = decide(now, r.kind, worker, attempt, int(r.at.timestamp() * 1000), self.lease_ms)
            out.append((key[0], r.at, outcome, now[0], now[2], now[1]))
        if now[0] is not None:
            self.state.update(now)
        if now[3] != before[3]:
            if before[3]:
                self.handle.deleteTimer(before[3])
            if now[0] == "leased":
                self.handle.registerTimer(now[3])
        yield pd.DataFrame(out, columns=["command_id", "at", "outcome", "status", "worker_id", "attempt"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        status, attempt, worker, ends = tuple(self.state.get())
        if status == "leased" and ends == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update(("pending", attempt, None, 0))
            at = pd.Timestamp(dt.datetime.fromtimestamp(ends / 1000, dt.UTC).replace(tzinfo=None))
            yield pd.DataFrame([(key[0], at, "expired", "pending", worker, attempt)], columns=["command_id", "at", "outcome", "status", "worker_id", "attempt"])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; set it before the stream is started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def leased(events: DataFrame, *, lease_ms: int = 60_000, late: str = "0 seconds") -> DataFrame:
    """What became of each event, and of leases that ended, from a stream of ``EVENT`` rows. Times are event times."""
    rows = events.withWatermark("at", late).groupBy("command_id")
    return rows.transformWithStateInPandas(Leases(lease_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime")

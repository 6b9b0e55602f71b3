"""The work queue: transitions, scheduling, retries, cancellation, recovery."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import attempts_left, backoff_seconds
from ..operators.listing import oldest_per_scope
from ..operators.scope import eligible, stale

#: The legal moves.
RUN_MOVES = (
    ("queued", "running"), ("queued", "cancelled"), ("running", "succeeded"), ("running", "queued"), ("running", "failed"), ("running", "cancelling"),
    ("cancelling", "cancelled"), ("cancelling", "failed"),
)
STEP_MOVES = (("queued", "running"), ("queued", "cancelled"), ("running", "succeeded"), ("running", "failed"), ("running", "queued"), ("running", "cancelled"))
BUSY = ("running", "cancelling")
FINAL = ("succeeded", "failed", "cancelled")


def legal(before: Column, after: Column, moves=RUN_MOVES) -> Column:
    """T11."""
    return F.concat_ws(">", before, after).isin(*(f"{a}>{b}" for a, b in moves))


def illegal_moves(log: DataFrame, moves=RUN_MOVES) -> DataFrame:
    """Entries of a log (before, after, ...) that no move allows."""
    return log.where(~legal(F.col("before"), F.col("after"), moves))


def submitted(runs: DataFrame, steps: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of queued runs and their queued steps. ``steps``: run_id, name, position, input_hash."""
    r = runs.withColumns({"status": F.lit("queued"), "attempt": F.lit(0), "progress": F.lit(0.0), "created_at": as_of, "next_attempt_at": F.lit(None).cast("timestamp"), "heartbeat_at": F.lit(None).cast("timestamp")})
    s = steps.join(runs.select("run_id"), "run_id", "left_semi").withColumns({"status": F.lit("queued"), "attempt": F.lit(0)})
    return r, s


def moved(runs: DataFrame, moves: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Runs after ``moves(run_id, target, error_code, next_attempt_at, worker_id)``, and the refused moves.

    Starting takes an attempt, a worker and a heartbeat; ending sets
    finished_at and clears the worker; going back to the queue sets
    next_attempt_at; success sets progress to 1.
    """
    m = moves.select("run_id", F.col("target").alias("_t"), *(F.col(c).alias(f"_{c}") for c in ("error_code", "next_attempt_at", "worker_id")))
    rows = runs.join(m, "run_id", "left")
    ok = F.coalesce(legal(F.col("status"), F.col("_t")), F.lit(False))
    to = lambda s: ok & (F.col("_t") == s)
    end = ok & F.col("_t").isin(*FINAL)
    new = rows.withColumns({
        "attempt": F.col("attempt") + to("running").cast("int"), "worker_id": F.when(to("running"), F.col("_worker_id")).when(end | to("queued"), F.lit(None)).otherwise(F.col("worker_id")),
        "heartbeat_at": F.when(to("running"), as_of).when(end | to("queued"), F.lit(None)).otherwise(F.col("heartbeat_at")), "started_at": F.when(to("running"), F.coalesce("started_at", as_of)).otherwise(F.col("started_at")),
        "finished_at": F.when(end, as_of).otherwise(F.col("finished_at")), "next_attempt_at": F.when(to("queued"), F.col("_next_attempt_at")).when(ok, F.lit(None)).otherwise(F.col("next_attempt_at")),
        "error_code": F.when(to("failed"), F.col("_error_code")).otherwise(F.col("error_code")), "progress": F.when(to("succeeded"), F.lit(1.0)).otherwise(F.col("progress")),
        "status": F.when(ok, F.col("_t")).otherwise(F.col("status")),
    })
    refused = rows.where(F.col("_t").isNotNull() & ~ok).select("run_id", F.col("status").alias("before"), F.col("_t").alias("after"))
    return new.select(*runs.columns), refused


def without_conflict(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Candidates whose scope nobody holds: a dataset by a run of its own or by a global one, the global scope by any other run.

    The OR of the four conditions is taken apart: one anti-join by dataset, and
    facts about the whole table as a scalar subquery.
    """
    busy = runs.where(F.col("status").isin(*BUSY))
    facts = busy.agg(F.struct(F.count_if(F.col("dataset_id").isNull()).alias("n_global"), F.count_if(F.col("dataset_id").isNotNull()).alias("n_scoped"), F.max(F.when(F.col("dataset_id").isNull(), F.col("run_id"))).alias("one_global"))).scalar()
    held = busy.where("dataset_id is not null").select("dataset_id").distinct()
    rows = candidates.join(held, "dataset_id", "left_anti").withColumn("_f", facts)
    n_global = F.col("_f.n_global")
    own = (n_global == 1) & (F.col("_f.one_global") == F.col("run_id"))
    free = F.when(F.col("dataset_id").isNotNull(), n_global == 0).otherwise((F.col("_f.n_scoped") == 0) & ((n_global == 0) | own))
    return rows.where(free).select(*candidates.columns)


def representatives(runs: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """The oldest eligible queued run of each free scope, in order of creation."""
    queued = runs.where("status = 'queued'").where(eligible(F.col("next_attempt_at"), as_of))
    rows = oldest_per_scope(without_conflict(queued, runs)).orderBy("created_at", "run_id")
    return rows if limit is None else rows.limit(limit)


def arbitrated(runs: DataFrame, as_of: Column) -> DataFrame:
    """The runs to start now: representatives, but no dataset's run that is younger than an eligible global one, and a global run only alone."""
    reps = representatives(runs, as_of)
    waiting = runs.where("status = 'queued' and dataset_id is null").where(eligible(F.col("next_attempt_at"), as_of))
    rows = reps.withColumn("g", waiting.agg(F.min(F.struct("created_at", "run_id"))).scalar())
    me = F.struct(F.col("created_at"), F.col("run_id"))
    scoped = rows.where("dataset_id is not null").where(F.col("g").isNull() | (me < F.col("g")))
    # A global run starts only if no dataset's run starts before it in the same round.
    alone = rows.where("dataset_id is null").withColumn("n", scoped.agg(F.count("*")).scalar()).where("n = 0").drop("n")
    return scoped.unionByName(alone).select(*reps.columns)


def failed_attempts(runs: DataFrame, failures: DataFrame, as_of: Column, jitter: Column, most: int = 5) -> DataFrame:
    """Moves for failed runs: retryable ones with attempts left go back to the queue, the others fail. ``failures``: run_id, retryable, error_code."""
    rows = runs.select("run_id", "attempt", "status").join(failures, "run_id")
    again = F.col("retryable") & attempts_left(F.col("attempt"), most) & (F.col("status") == "running")
    wait = backoff_seconds(F.col("attempt"), jitter)
    return rows.select("run_id", F.when(again, "queued").otherwise("failed").alias("target"), F.when(~again, F.col("error_code")).alias("error_code"), F.when(again, as_of + F.make_dt_interval(secs=wait)).alias("next_attempt_at"), F.lit(None).cast("string").alias("worker_id"))


def cancel_moves(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """Queued runs are cancelled at once, running ones at their next step; a run that is cancelling never succeeds."""
    rows = runs.join(asked.select("run_id").distinct(), "run_id").where("status in ('queued', 'running')")
    return rows.select("run_id", F.when(F.col("status") == "queued", "cancelled").otherwise("cancelling").alias("target"))


def after_step(status: Column, step_ok: Column, last: Column) -> Column:
    """What a run becomes when a step ends."""
    return F.when(status == "cancelling", F.when(step_ok, "cancelled").otherwise("failed")).when(~step_ok, "failed").when(last, "succeeded").otherwise("running")


def heartbeats(runs: DataFrame, beats: DataFrame, as_of: Column) -> DataFrame:
    """``beats(run_id, worker_id, attempt)`` count only for the worker and attempt that hold the run."""
    b = beats.select("run_id", F.col("worker_id").alias("_w"), F.col("attempt").alias("_a")).distinct()
    rows = runs.join(b, "run_id", "left")
    own = F.col("status").isin(*BUSY) & (F.col("_w") == F.col("worker_id")) & (F.col("_a") == F.col("attempt"))
    return rows.withColumn("heartbeat_at", F.when(own, as_of).otherwise(F.col("heartbeat_at"))).select(*runs.columns)


def drifted(steps: DataFrame, now: DataFrame) -> DataFrame:
    """Steps with ``action``: skip (succeeded on the same input), drift (succeeded on another one), or run."""
    n = now.select("run_id", "name", F.col("input_hash").alias("_h"))
    done = F.col("status") == "succeeded"
    return steps.join(n, ["run_id", "name"], "left").withColumn("action", F.when(done & F.col("input_hash").eqNullSafe(F.col("_h")), "skip").when(done, "drift").otherwise("run")).drop("_h")


def recovery(runs: DataFrame, steps: DataFrame, as_of: Column, jitter: Column, *, fingerprint: str, stale_after: float = 300, most: int = 5, at_startup: bool = True, recovery_mode: Column | None = None) -> DataFrame:
    """What becomes of stale runs: (run_id, before, target, error_code, next_attempt_at, step_target, cancel_queued).

    ``step_target`` is the move of the running step, if one moves. ``recovery_mode``:
    of the step that was running when its run was being cancelled: atomic and
    reconciled ones end cancelled, others are ambiguous and fail.
    """
    s = steps.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "running").alias("n_running"), F.count_if(F.col("status") == "succeeded").alias("n_done"), F.max(F.when(F.col("status") == "running", F.col("name"))).alias("orphan"))
    rows = runs.where(F.col("status").isin(*BUSY)).where(stale(F.col("heartbeat_at"), as_of, stale_after, null_is_stale=at_startup)).join(s, "run_id", "left").na.fill(0, ["n", "n_running", "n_done"])
    lost, other, vague = F.lit("worker_lost"), F.lit("config_fingerprint_mismatch"), F.lit("cancel_recovery_ambiguous")
    run_error = (
        F.when(~F.col("config_fingerprint").eqNullSafe(F.lit(fingerprint)), other).when(F.col("heartbeat_at").isNull(), lost).when(~attempts_left(F.col("attempt"), most), lost)
        .when(F.col("n") == 0, lost).when((F.col("n_running") > 1) | (F.col("n_done") == F.col("n")), lost)
    )
    mode = recovery_mode if recovery_mode is not None else F.lit("ambiguous")
    cancel_error = F.when(F.col("heartbeat_at").isNull() | (F.col("n") == 0) | (F.col("n_running") > 1), vague).when((F.col("n_running") == 1) & ~F.coalesce(mode.isin("atomic", "reconciled"), F.lit(False)), vague)
    running = F.col("status") == "running"
    error = F.when(running, run_error).otherwise(cancel_error)
    target = F.when(error.isNotNull(), "failed").when(running, "queued").otherwise("cancelled")
    wait = backoff_seconds(F.col("attempt"), jitter)
    step = F.when(F.col("n_running") == 0, F.lit(None)).otherwise(F.when(error.isNotNull(), "failed").when(running, "queued").otherwise("cancelled"))
    return rows.select(
        "run_id", F.col("status").alias("before"), target.alias("target"), error.alias("error_code"), F.when(target == "queued", as_of + F.make_dt_interval(secs=wait)).alias("next_attempt_at"),
        step.alias("step_target"), (target == "cancelled").alias("cancel_queued"),
    )


# --- the state machine as a stream ---------------------------------------------------------------

EVENT = "run_id string, at timestamp, kind string, attempt int, worker_id string"
STATE = "status string, attempt int, worker_id string, beat timestamp, refused int"
ROW = "run_id string, status string, attempt int, worker_id string, refused int, timed_out boolean"
KINDS = {"submit": "queued", "start": "running", "succeed": "succeeded", "fail": "failed", "retry": "queued", "cancel": "cancelling", "cancelled": "cancelled"}


def step(state: tuple, kind: str, attempt, worker, at) -> tuple:
    """One event on (status, attempt, worker, beat, refused). Illegal moves and those of a superseded attempt are counted and change nothing."""
    status, have, who, beat, refused = state
    if kind == "submit" and status is None:
        return "queued", 0, None, None, refused
    if kind == "beat":
        return (status, have, who, at, refused) if status in BUSY and worker == who and attempt == have else (status, have, who, beat, refused + 1)
    target = KINDS.get(kind)
    if kind == "cancel" and status == "queued":
        target = "cancelled"
    superseded = kind != "start" and kind != "cancel" and attempt is not None and attempt != have
    if superseded or (status, target) not in RUN_MOVES:
        return status, have, who, beat, refused + 1
    if target == "running":
        return "running", have + 1, worker, at, refused
    return target, have, (who if target == "cancelling" else None), (beat if target == "cancelling" else None), refused


def run_states(events: DataFrame, *, stale_after_ms: int = 300_000) -> DataFrame:
    """The state of every run from a stream of events; a run without an event for ``stale_after_ms`` is reported as timed out (processing time)."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (None, 0, None, None, 0)
        late = state.hasTimedOut
        if not late:
            rows = pd.concat(list(batches)).sort_values("at", kind="stable")
            for r in rows.itertuples(index=False):
                now = step(now, r.kind, None if pd.isna(r.attempt) else int(r.attempt), r.worker_id, r.at.to_pydatetime())
        if late or now[0] in FINAL or now[0] is None:
            state.remove() if state.exists else None
        else:
            state.update(now)
            state.setTimeoutDuration(stale_after_ms)
        yield pd.DataFrame([{"run_id": key[0], "status": now[0], "attempt": now[1], "worker_id": now[2], "refused": now[4], "timed_out": late}])

    return events.groupBy("run_id").applyInPandasWithState(fold, ROW, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)

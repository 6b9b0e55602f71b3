"""Outbox and queue: batch functions, and the same as streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import projection
from quillgraph.streaming import events as ev
from quillgraph.streaming import outbox, runs

def now():
    return F.lit(dt.datetime(2024, 1, 1, 12))


BEFORE = dt.datetime(2024, 1, 1, 11)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def box(spark):
    return spark.createDataFrame([
        (1, "pending", 0, None, None), (2, "processing", 1, BEFORE, "w"), (3, "processing", 1, dt.datetime(2024, 1, 1, 11, 59), "w"), (4, "failed", 5, None, None), (5, "failed", 4, None, None), (6, "done", 1, None, None), (7, "processing", 1, None, "w"),
    ], "id long, status string, attempt int, processing_started_at timestamp, worker_id string").withColumn("aggregate_type", F.lit("entity"))


def test_claims_and_fencing(spark):
    b = box(spark)
    assert rows(outbox.claimable_ids(b, now()), "id") == [(1,), (2,), (5,), (7,)]
    c = outbox.claimed(b, outbox.claimable_ids(b, now(), 2), "me", now())
    assert rows(c.where("worker_id = 'me'"), "id", "attempt", "status") == [(1, 1, "processing"), (2, 2, "processing")]
    res = spark.createDataFrame([(1, "me", 1, True), (2, "w", 1, True), (3, "w", 1, False)], "id long, worker_id string, attempt int, ok boolean")
    assert rows(outbox.finalised(c, res).where("id <= 3"), "id", "status") == [(1, "done"), (2, "processing"), (3, "failed")]
    assert [r.id for r in outbox.drain_order(b).collect()] == [1, 2, 3, 5, 7]


def test_stream_equals_batch(spark, tmp_path):
    n = 60
    cmds = spark.range(n).select(
        F.col("id"), F.lit("d").alias("dataset_id"), F.when(F.col("id") % 7 == 6, "odd").otherwise("entity").alias("aggregate_type"), (F.col("id") % 11).cast("string").alias("aggregate_id"),
        F.when(F.col("id") % 5 == 0, "delete").otherwise("upsert").alias("operation"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("target_id"), F.concat(F.lit("p"), "id").alias("payload"),
        F.lit("pending").alias("status"), F.lit(0).alias("attempt"), F.lit(None).cast("timestamp").alias("processing_started_at"))
    src, state, dead, chk = (str(tmp_path / x) for x in ("src", "state", "dead", "chk"))
    for k in range(4):
        cmds.where(F.col("id") % 4 == k).coalesce(1).write.mode("append").parquet(src)
        outbox.apply_stream(spark, src, state, dead, chk, per_batch=1).awaitTermination(120)
    got = outbox.newest(spark, state)
    want = projection.latest_state(cmds.where(outbox.consistent()).drop("status", "attempt", "processing_started_at"))
    assert rows(got, "aggregate_id", "id", "operation") == rows(want, "aggregate_id", "id", "operation")
    assert spark.read.parquet(dead).count() == cmds.where("aggregate_type = 'odd'").count()


def test_state_is_rewritten_by_bucket(spark, tmp_path, monkeypatch):
    """Whole rewrites at other distances give the same state, and a small batch touches few buckets."""
    monkeypatch.setattr(outbox, "WHOLE", 3)
    cmds = spark.range(40).select(
        F.col("id"), F.lit("d").alias("dataset_id"), F.lit("entity").alias("aggregate_type"), F.when(F.col("id") < 30, F.col("id")).otherwise(F.col("id") % 2).cast("string").alias("aggregate_id"),
        F.lit("upsert").alias("operation"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("target_id"), F.lit("p").alias("payload"),
        F.lit("pending").alias("status"), F.lit(0).alias("attempt"), F.lit(None).cast("timestamp").alias("processing_started_at"))
    src, state, dead, chk = (str(tmp_path / x) for x in ("src", "state", "dead", "chk"))
    for low, high in ((0, 30), (30, 32), (32, 34), (34, 38), (38, 40)):
        cmds.where(F.col("id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(src)
        outbox.apply_stream(spark, src, state, dead, chk, per_batch=1).awaitTermination(120)
        want = projection.latest_state(cmds.where(F.col("id") < high))
        assert rows(outbox.newest(spark, state), "aggregate_id", "id") == rows(want, "aggregate_id", "id")
    count = lambda n: len(list((tmp_path / "state" / f"batch={n:012d}").glob("bucket=*")))
    assert count(1) <= 2 and count(2) <= 2 < count(3) and count(4) <= 2
    assert outbox.newest(spark, state, below=0) is None


def test_appended_ids_are_contiguous(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    got = outbox.appended(df, 50, ["g", "k"]).orderBy("g", "k").collect()
    assert [r.id for r in got] == list(range(51, 1051))
    assert outbox.appended(df.where("false"), 50, ["g", "k"]).count() == 0


def queue(spark, data):
    return spark.createDataFrame(data, "run_id int, dataset_id string, status string, created_at int, next_attempt_at timestamp")


@pytest.mark.parametrize("data,want", [
    ([(1, "a", "queued", 1, None), (2, "a", "queued", 2, None), (3, "b", "queued", 3, None)], [1, 3]),
    ([(1, "a", "running", 1, None), (2, "a", "queued", 2, None), (3, "b", "queued", 3, None)], [3]),
    ([(1, None, "running", 1, None), (2, "a", "queued", 2, None)], []),
    ([(1, None, "queued", 1, None), (2, "a", "queued", 2, None)], [1]),
    ([(1, None, "queued", 3, None), (2, "a", "queued", 2, None), (3, "b", "queued", 4, None)], [2]),
    ([(1, "a", "queued", 1, dt.datetime(2025, 1, 1)), (2, "b", "queued", 2, None)], [2]),
    ([(1, "a", "cancelling", 1, None), (2, None, "queued", 2, None)], []),
])
def test_scheduling(spark, data, want):
    assert [r.run_id for r in runs.arbitrated(queue(spark, data), now()).orderBy("run_id").collect()] == want


def test_transitions(spark):
    r = spark.createDataFrame([(1, "queued", 0, None, None, None, None, None, None, 0.0), (2, "running", 1, "w", None, None, None, None, None, 0.5), (3, "succeeded", 1, None, None, None, None, None, None, 1.0)], "run_id int, status string, attempt int, worker_id string, heartbeat_at timestamp, started_at timestamp, finished_at timestamp, next_attempt_at timestamp, error_code string, progress double")
    m = spark.createDataFrame([(1, "running", None, None, "me"), (2, "succeeded", None, None, None), (3, "queued", None, None, None)], "run_id int, target string, error_code string, next_attempt_at timestamp, worker_id string")
    new, refused = runs.moved(r, m, now())
    got = {x.run_id: x for x in new.collect()}
    assert (got[1].status, got[1].attempt, got[1].worker_id) == ("running", 1, "me") and got[1].heartbeat_at is not None
    assert (got[2].status, got[2].progress, got[2].worker_id) == ("succeeded", 1.0, None) and got[2].finished_at is not None
    assert got[3].status == "succeeded" and rows(refused, "run_id", "before", "after") == [(3, "succeeded", "queued")]
    beat = spark.createDataFrame([(1, "me", 1), (2, "zz", 1)], "run_id int, worker_id string, attempt int")
    later = F.lit(dt.datetime(2024, 1, 1, 13))
    assert [x.run_id for x in runs.heartbeats(new, beat, later).where(F.col("heartbeat_at") == later).collect()] == [1]


def test_failures_and_cancelling(spark):
    r = spark.createDataFrame([(1, 1, "running"), (2, 5, "running"), (3, 1, "cancelling"), (4, 0, "queued")], "run_id int, attempt int, status string")
    f = spark.createDataFrame([(1, True, "x"), (2, True, "x"), (3, True, "x")], "run_id int, retryable boolean, error_code string")
    got = {x.run_id: x for x in runs.failed_attempts(r, f, now(), F.lit(0.5)).collect()}
    assert [got[k].target for k in (1, 2, 3)] == ["queued", "failed", "failed"]
    assert got[1].next_attempt_at == dt.datetime(2024, 1, 1, 12, 0, 1, 500000)
    assert rows(runs.cancel_moves(r, r), "run_id", "target") == [(1, "cancelling"), (2, "cancelling"), (4, "cancelled")]
    s = spark.createDataFrame([("cancelling", True, True), ("running", True, True), ("running", True, False), ("running", False, False), ("cancelling", False, True)], "s string, ok boolean, last boolean")
    assert [x.t for x in s.select(runs.after_step(F.col("s"), F.col("ok"), F.col("last")).alias("t")).collect()] == ["cancelled", "succeeded", "running", "failed", "failed"]


@pytest.mark.parametrize("run,steps,want", [
    (("running", "fp", BEFORE, 1), ["succeeded", "running"], ("queued", None, "queued")), (("running", "other", BEFORE, 1), ["running"], ("failed", "config_fingerprint_mismatch", "failed")),
    (("running", "fp", None, 1), ["running"], ("failed", "worker_lost", "failed")), (("running", "fp", BEFORE, 5), ["running"], ("failed", "worker_lost", "failed")),
    (("running", "fp", BEFORE, 1), [], ("failed", "worker_lost", None)), (("running", "fp", BEFORE, 1), ["running", "running"], ("failed", "worker_lost", "failed")),
    (("running", "fp", BEFORE, 1), ["succeeded"], ("failed", "worker_lost", None)), (("running", "fp", BEFORE, 1), ["succeeded", "queued"], ("queued", None, None)),
    (("cancelling", "fp", BEFORE, 1), ["succeeded", "queued"], ("cancelled", None, None)), (("cancelling", "fp", None, 1), ["queued"], ("failed", "cancel_recovery_ambiguous", None)),
    (("cancelling", "fp", BEFORE, 1), ["running"], ("failed", "cancel_recovery_ambiguous", "failed")),
])
def test_recovery(spark, run, steps, want):
    r = spark.createDataFrame([(1, *run)], "run_id int, status string, config_fingerprint string, heartbeat_at timestamp, attempt int")
    s = spark.createDataFrame([(1, f"s{i}", x) for i, x in enumerate(steps)], "run_id int, name string, status string")
    got = runs.recovery(r, s, now(), F.lit(0.0), fingerprint="fp").first()
    assert (got.target, got.error_code, got.step_target) == want
    if run[0] == "cancelling" and steps == ["running"]:
        assert runs.recovery(r, s, now(), F.lit(0.0), fingerprint="fp", recovery_mode=F.lit("atomic")).first().target == "cancelled"


def test_fresh_runs_are_left_alone(spark):
    r = spark.createDataFrame([(1, "running", "fp", dt.datetime(2024, 1, 1, 11, 59), 1)], "run_id int, status string, config_fingerprint string, heartbeat_at timestamp, attempt int")
    assert runs.recovery(r, spark.createDataFrame([], "run_id int, name string, status string"), now(), F.lit(0.0), fingerprint="fp").count() == 0


def test_drift(spark):
    s = spark.createDataFrame([(1, "a", "succeeded", "h"), (1, "b", "succeeded", "old"), (1, "c", "queued", None)], "run_id int, name string, status string, input_hash string")
    today = spark.createDataFrame([(1, "a", "h"), (1, "b", "new"), (1, "c", "x")], "run_id int, name string, input_hash string")
    assert rows(runs.drifted(s, today), "name", "action") == [("a", "skip"), ("b", "drift"), ("c", "run")]


def test_run_state_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    log = [("r1", "submit", None, None), ("r1", "start", None, "w1"), ("r1", "retry", 1, "w1"), ("r1", "start", None, "w2"), ("r1", "succeed", 1, "w1"), ("r1", "succeed", 2, "w2"), ("r2", "submit", None, None), ("r2", "cancel", None, None), ("r3", "start", None, "w")]
    data = [(r, t0 + dt.timedelta(seconds=i), k, a, w) for i, (r, k, a, w) in enumerate(log)]
    src = str(tmp_path / "events")
    spark.createDataFrame(data, runs.EVENT).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(runs.EVENT).parquet(src)
    q = runs.run_states(stream).writeStream.format("memory").queryName("run_states").outputMode("append").option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.run_id: r for r in spark.table("run_states").collect()}
    assert (got["r1"].status, got["r1"].attempt, got["r1"].refused) == ("succeeded", 2, 1)
    assert got["r2"].status == "cancelled" and got["r3"].status is None and got["r3"].refused == 1


def test_windows_stream(spark, sf_dir, tmp_path):
    src = f"{sf_dir}/events.parquet"
    batch = ev.tumbling(spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp")))
    folder = tmp_path / "ev"
    spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(ev.TYPES).parquet(str(folder))
    q = ev.tumbling(stream).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("tumbling"), "start", "event_type", "n") == rows(batch, "start", "event_type", "n")
    e = spark.read.parquet(str(folder))
    assert ev.sessions(e).count() > 0 and ev.sliding(e).count() >= ev.tumbling(e).select("start").distinct().count() and ev.deduplicated(e.union(e)).count() == e.count()

"""Leases: the rules alone, and a stream that is stopped and goes on, with a lease that ends in between."""

import datetime as dt

from quillgraph.streaming import leases

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(seconds):
    return (T0 + dt.timedelta(seconds=seconds)).replace(tzinfo=None)


def test_rules():
    s, told = (None, 0, None, 0), []
    for kind, who, attempt, ms in [("claim", "a", None, 1), ("submit", None, None, 1), ("submit", None, None, 2), ("claim", "a", None, 3), ("claim", "b", None, 4), ("beat", "b", 1, 5), ("beat", "a", 1, 50), ("claim", "b", None, 149), ("claim", "b", None, 150), ("done", "a", 1, 151), ("done", "b", 2, 152), ("done", "b", 2, 153), ("claim", "c", None, 999)]:
        s, outcome = leases.decide(s, kind, who, attempt, ms, 100)
        told.append(outcome)
    assert told == ["refused", "submitted", "repeated", "granted", "refused", "refused", "extended", "refused", "granted", "refused", "done", "refused", "refused"]
    assert s[:3] == ("done", 2, "b")


def test_restart_with_a_lease_that_ends(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    leases.use_rocksdb(spark)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def feed(*rows):
        spark.createDataFrame([(c, at(t), k, w, a) for c, t, k, w, a in rows], leases.EVENT).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(leases.EVENT).parquet(folder)
        q = leases.leased(stream, lease_ms=60_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.command_id, r.outcome, r.worker_id, r.attempt) for r in spark.read.parquet(out).collect())

    try:
        feed(("c1", 0, "submit", None, None), ("c1", 1, "claim", "w1", None), ("c2", 0, "submit", None, None), ("c2", 2, "claim", "w1", None))
        first = run()
        assert ("c1", "granted", "w1", 1) in first and ("c2", "granted", "w1", 1) in first
        feed(("c2", 30, "done", "w1", 1), ("c3", 100, "submit", None, None))  # the watermark passes the end of the lease of c1
        second = run()
        assert ("c1", "expired", "w1", 1) in second and ("c2", "done", "w1", 1) in second and ("c2", "expired", "w1", 1) not in second
        feed(("c1", 110, "claim", "w2", None), ("c1", 111, "done", "w1", 1), ("c1", 112, "done", "w2", 2), ("c1", 113, "done", "w2", 2), ("c2", 114, "claim", "w2", None))
        third = [x for x in run() if x not in second]
        assert third == [("c1", "done", "w2", 2), ("c1", "granted", "w2", 2), ("c1", "refused", "w2", 2), ("c1", "refused", "w2", 2), ("c2", "refused", "w1", 1)]
        refused = [r for r in spark.read.parquet(out).where("outcome = 'refused'").collect()]
        assert len(refused) == 3  # the late result of w1, the repeated one of w2, the claim of what is done
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)

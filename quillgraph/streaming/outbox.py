"""The projection outbox as an append-only stream.

Row locks have no counterpart here: a micro-batch owns its rows, and
the sink is idempotent by (query, batch), so a batch that runs again after a
failure writes the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.graph import kept
from ..operators.projection import COMMAND, EDGES, ORDER, dependency_order, latest_state
from ..operators.scope import stale

BURST = 50
BUCKETS, WHOLE = 256, 64
SCHEMA = "id bigint, " + ", ".join(f"{c} string" for c in COMMAND) + ", status string, attempt int, processing_started_at timestamp"


def appended(commands: DataFrame, after: int, order: list[str]) -> DataFrame:
    """Commands with contiguous ids that follow ``after`` in a total order.

    Rows are sorted by ranges and numbered inside their partition; the sizes of
    the partitions before it (one row a partition) are added.
    """
    inside = (1 << 33) - 1  # the bits of a monotonic id that count inside a partition
    placed = kept(commands.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = placed.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    rows = rows.withColumn("id", (F.lit(after + 1) + F.col("_before") + F.col("_at").bitwiseAND(F.lit(inside))).cast("bigint"))
    return rows.drop("_part", "_before", "_at").withColumns({"status": F.lit("pending"), "attempt": F.lit(0), "processing_started_at": F.lit(None).cast("timestamp")})


def claimable(as_of: Column, *, stale_after: float = 300, most_attempts: int = 5) -> Column:
    """Pending, processing under a stale or missing lease, or failed with attempts left."""
    lease = stale(F.col("processing_started_at"), as_of, stale_after, null_is_stale=True)
    return (F.col("status") == "pending") | ((F.col("status") == "processing") & lease) | ((F.col("status") == "failed") & (F.col("attempt") < most_attempts))


def claimable_ids(outbox: DataFrame, as_of: Column, limit: int = BURST, **options) -> DataFrame:
    """The oldest claimable rows."""
    return outbox.where(claimable(as_of, **options)).select("id").orderBy("id").limit(limit)


def drain_order(outbox: DataFrame, *, most_attempts: int = 5) -> DataFrame:
    """Everything not yet at an end, nodes before what needs them."""
    open_ = outbox.where((F.col("status").isin("pending", "processing")) | ((F.col("status") == "failed") & (F.col("attempt") < most_attempts)))
    return open_.withColumn("position", dependency_order(F.col("aggregate_type"))).orderBy("position", "id")


def claimed(outbox: DataFrame, ids: DataFrame, worker: str, as_of: Column) -> DataFrame:
    """Claimed rows go to processing with one attempt more; each id has one owner."""
    k = ids.select("id").distinct().withColumn("_c", F.lit(True))
    rows = outbox.join(k, "id", "left")
    hit = F.col("_c").isNotNull()
    worker_id = F.when(hit, F.lit(worker))
    if "worker_id" in outbox.columns:
        worker_id = worker_id.otherwise(F.col("worker_id"))
    rows = rows.withColumns({"status": F.when(hit, "processing").otherwise(F.col("status")), "attempt": F.col("attempt") + hit.cast("int"), "processing_started_at": F.when(hit, as_of).otherwise(F.col("processing_started_at")), "worker_id": worker_id})
    return rows.drop("_c")


def finalised(outbox: DataFrame, results: DataFrame) -> DataFrame:
    """``results(id, worker_id, attempt, ok)`` end their rows; a result of a lease that has been superseded changes nothing."""
    r = results.select("id", F.col("worker_id").alias("_w"), F.col("attempt").alias("_a"), F.col("ok").alias("_ok"))
    rows = outbox.join(r, "id", "left")
    own = (F.col("status") == "processing") & F.col("_w").eqNullSafe(F.col("worker_id")) & (F.col("_a") == F.col("attempt"))
    return rows.withColumn("status", F.when(own & F.col("_ok"), "done").when(own & ~F.col("_ok"), "failed").otherwise(F.col("status"))).select(*outbox.columns)


def consistent() -> Column:
    """The row and its payload name the same thing: a known kind, ends exactly for edges."""
    edge = F.col("aggregate_type").isin(*EDGES)
    return F.coalesce(F.col("aggregate_type").isin(*ORDER) & F.col("operation").isin("upsert", "delete") & (edge == (F.col("source_id").isNotNull() & F.col("target_id").isNotNull())), F.lit(False))


def apply_stream(spark: SparkSession, source: str, state: str, dead: str, checkpoint: str, *, per_batch: int = BURST, continuous_seconds: int | None = None) -> StreamingQuery:
    """Drain (or, with ``continuous_seconds``, keep draining) Parquet command files into the latest state of each aggregate.

    Aggregates fall into ``BUCKETS`` by hash. A batch reads and writes the
    buckets that its commands touch, in a folder of its own; every ``WHOLE``-th
    batch writes all buckets, so that nothing before it is looked at again. A
    repeated batch overwrites its folder. A deleted aggregate stays as a delete.
    """
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(source)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.where(~consistent()).write.mode("overwrite").parquet(f"{dead}/batch={batch_id}")
        good = batch.where(consistent()).drop("status", "attempt", "processing_started_at")
        touched = None if batch_id % WHOLE == 0 else {r.bucket for r in good.select(bucket().alias("bucket")).distinct().collect()}
        before = newest(batch.sparkSession, state, below=batch_id, buckets=touched)
        merged = good if before is None else before.unionByName(good)
        latest = latest_state(merged).withColumn("bucket", bucket())
        latest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/batch={batch_id:012d}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if continuous_seconds is None else writer.trigger(processingTime=f"{continuous_seconds} seconds")
    return writer.start()


def bucket() -> Column:
    """The part of the state that a command's aggregate belongs to."""
    return F.pmod(F.xxhash64("dataset_id", "aggregate_type", "aggregate_id"), F.lit(BUCKETS)).cast("int")


def newest(spark: SparkSession, state: str, below: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The newest complete state (before a batch; of some buckets), found through Hadoop's file system so that any store works."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    numbered = lambda at, mark: {int(s.getPath().getName()[len(mark) :]) for s in fs.listStatus(at) if s.getPath().getName().startswith(mark)}
    paths: dict[int, str] = {}
    for n in sorted(numbered(path, "batch="), reverse=True):
        folder = jvm.org.apache.hadoop.fs.Path(path, f"batch={n:012d}")
        if (below is not None and n >= below) or not fs.exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            continue
        for k in numbered(folder, "bucket="):
            paths.setdefault(k, f"{state}/batch={n:012d}/bucket={k}")
        if n % WHOLE == 0:
            break
    chosen = [p for k, p in paths.items() if buckets is None or k in buckets]
    return spark.read.parquet(*chosen) if chosen else None

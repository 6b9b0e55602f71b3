"""Exact nearest rows and similar pairs behind pivots.

Unit vectors have the chord distance sqrt(2 - 2 cos), a metric. Every row
belongs to the cell of its nearest pivot and knows the distance to it. For a
query at distance d of a pivot, rows of that cell whose own distance differs
from d by more than the answer's radius cannot be in the answer, and neither
can those beyond the plane between two pivots; so cells, and inside them ranges
of rows, are left out and the result stays exact. Where directions have no
clusters nothing can be left out, and all rows are read, as without an index.

Pivots are rows drawn by hash, at most ``MOST_PIVOTS``, so what is broadcast is
bounded. Rows whose vector is null, zero, of another width or has components
that are null or not finite take no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import valid_components

MOST_PIVOTS = 256
SLACK = 1e-9  # of distances, against rounding


def unit_rows(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, embedding) of the rows that can be compared."""
    rows = rows.select(F.col(id_col).alias("id"), "embedding").where("embedding is not null and size(embedding) > 0")
    return rows.where(valid_components(F.col("embedding"))).where(F.exists("embedding", lambda x: x != 0))


def units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


@dataclass
class MetricIndex:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, id_col: str, pivots: int = MOST_PIVOTS) -> MetricIndex:
        """Write ``rows(id, embedding)`` of the commonest width, a folder a cell, and what is known of each cell."""
        spark = rows.sparkSession
        ready = unit_rows(rows, id_col)
        widths = ready.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
        ready = ready.where(F.size("embedding") == (widths["w"] if widths else 0))
        drawn = ready.orderBy(F.xxhash64("id"), "id").limit(min(pivots, MOST_PIVOTS, max(1, math.isqrt(widths["count"])) if widths else 1)).select("embedding").toArrow()
        at = units(drawn.column(0)) if drawn.num_rows else np.empty((0, 1))
        known = spark.sparkContext.broadcast(at)
        kind = ready.schema["id"].dataType.simpleString()

        def cells(batches):
            for b in batches:
                if b.num_rows:
                    far = chords(units(b.column("embedding")), known.value)
                    cell = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("embedding"), pa.array(far[np.arange(len(cell)), cell]), pa.array(cell.astype(np.int32))], names=["id", "embedding", "dist", "cell"])

        element = ready.schema["embedding"].dataType.elementType.simpleString()
        placed = ready.mapInArrow(cells, f"id {kind}, embedding array<{element}>, dist double, cell int")
        ready.select("id").limit(0).coalesce(1).write.parquet(f"{path}/ids")
        placed.repartition("cell").sortWithinPartitions("cell", "dist").write.partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(at)], "cell int, pivot array<double>").coalesce(1).write.parquet(f"{path}/pivots")
        spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    def reach(self, query: list[float]) -> list[tuple[float, float, int, int]]:
        """(least distance that a row of the cell can have, distance of its pivot, cell, rows) of every cell, nearest first."""
        pivots = {r.cell: r.pivot for r in self.spark.read.parquet(f"{self.path}/pivots").collect()}
        q = np.asarray(query, dtype=np.float64)
        if not pivots or len(q) != len(next(iter(pivots.values()))) or not np.linalg.norm(q) > 0:
            return []
        q = q / np.linalg.norm(q)
        far = {c: float(chords(q[None, :], np.array([p]))[0, 0]) for c, p in pivots.items()}
        best = min(far, key=far.__getitem__)
        out = []
        for r in self.spark.read.parquet(f"{self.path}/cells").collect():
            d = far[r.cell]
            apart = float(chords(np.array([pivots[r.cell]]), np.array([pivots[best]]))[0, 0])
            plane = (d * d - far[best] ** 2) / (2 * apart) if apart > 0 else 0.0  # how far the plane to the nearest pivot is
            out.append((max(0.0, d - r.high, r.low - d, plane - SLACK), d, r.cell, r.n))
        return sorted(out)

    def within(self, query: list[float], cells: list[tuple[float, float, int, int]], radius: float) -> DataFrame:
        """(id, score) of rows in ``cells`` that may lie within ``radius``: folders by cell, row groups by distance."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        near = [(F.col("cell") == c) & F.col("dist").between(d - radius - SLACK, d + radius + SLACK) for _, d, c, _ in cells]
        rows = rows.where(F.col("cell").isin([c for *_, c, _ in cells]))
        if radius < 2:
            any_ = near[0]
            for x in near[1:]:
                any_ = any_ | x
            rows = rows.where(any_)
        q = self.spark.sparkContext.broadcast(np.asarray(query, dtype=np.float64))
        kind = rows.schema["id"].dataType.simpleString()

        def scores(batches):
            length = np.linalg.norm(q.value)
            for b in batches:
                if b.num_rows:
                    m = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(m @ q.value / (np.linalg.norm(m, axis=1) * length))], names=["id", "score"])

        return rows.select("id", "embedding").mapInArrow(scores, f"id {kind}, score double")

    def top_k(self, query: list[float], k: int, *, only: DataFrame | None = None) -> tuple[DataFrame, float]:
        """(id, score) of the k nearest by cosine, ties by id, and the share of rows in the cells that were read. ``only``: ids that may be found."""
        mine = (lambda df: df) if only is None else (lambda df: df.join(only.select("id").distinct(), "id", "left_semi"))
        cells = self.reach(query)
        if not cells:
            return self.spark.read.parquet(f"{self.path}/ids").select("id", F.lit(0.0).alias("score")), 0.0
        radius, used, step = 2.0, 0, 1
        while used < len(cells):  # the nearest cells, twice as many a time, until they hold k rows
            head, n = [], 0
            while used + len(head) < len(cells) and (n < k or len(head) < step):
                head.append(cells[used + len(head)])
                n += head[-1][3]
            used, step = used + len(head), 2 * (used + len(head))
            best = mine(self.within(query, cells[:used], 2.0)).orderBy(F.desc("score"), "id").limit(k).select("score").collect()
            if len(best) == k:
                radius = math.sqrt(max(0.0, 2 - 2 * best[-1].score)) + SLACK
                break
        reached = [c for c in cells if c[0] <= radius + SLACK]
        share = sum(c[3] for c in reached) / max(1, sum(c[3] for c in cells))
        return mine(self.within(query, reached, radius)).orderBy(F.desc("score"), "id").limit(k), share


def placed_rows(rows: DataFrame, threshold: float, *, tile: int, pivots: int = MOST_PIVOTS) -> DataFrame:
    """(block, id, embedding, cell, home): each row of ``rows(block, id, embedding)`` in its cell, and in those that it visits.

    A row visits the later cells in which a partner may live: those behind a
    plane between pivots that is no farther than the radius. Blocks of one tile
    have one cell. Pivots go to the largest blocks first.
    """
    spark = rows.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    kind = rows.schema["id"].dataType.simpleString()
    element = rows.schema["embedding"].dataType.elementType.simpleString()
    sizes = rows.groupBy("block").count().where(F.col("count") > tile).orderBy(F.desc("count"), "block").limit(pivots // 2).collect()
    shares, left = {}, pivots
    for r in sizes:
        shares[r.block] = min(left, max(2, math.isqrt(r["count"] // tile) * 4), 64)
        left -= shares[r.block]
        if left < 2:
            break
    drawn: dict = {}
    if shares:
        want = F.create_map(*(F.lit(x) for b, n in shares.items() for x in (b, n)))
        count = F.create_map(*(F.lit(x) for r in sizes if r.block in shares for x in (r.block, r["count"])))
        # Some twice as many as wanted by hash; the first of them are taken.
        some = rows.where(F.pmod(F.xxhash64("id"), F.element_at(count, F.col("block"))) < 2 * F.element_at(want, F.col("block")) + 8)
        for r in some.select("block", "id", "embedding").orderBy(F.xxhash64("id"), "id").toLocalIterator():
            if len(drawn.setdefault(r.block, [])) < shares[r.block]:
                drawn[r.block].append(r.embedding)
    known = spark.sparkContext.broadcast({b: np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64), axis=1, keepdims=True) for b, v in drawn.items()})

    def visits(batches):
        for b in batches:
            if not b.num_rows:
                continue
            blocks, vectors = b.column("block").to_pylist(), b.column("embedding")
            order, cell, home = [], [], []
            by: dict = {}
            for i, x in enumerate(blocks):
                by.setdefault(x, []).append(i)
            for x, at in by.items():
                p = known.value.get(x)
                if p is None:
                    far = np.zeros((len(at), 1))
                else:
                    far = chords(units(vectors.take(pa.array(at))), p)
                own = far.argmin(axis=1)
                # A partner in another cell lies beyond the plane between the two pivots, so that is within the radius.
                apart = np.zeros((1, 1)) if p is None else chords(p, p)
                near = far**2 - far.min(axis=1, keepdims=True) ** 2 <= 2 * radius * apart[own] + SLACK
                near &= np.arange(far.shape[1])[None, :] >= own[:, None]
                i, c = np.nonzero(near)
                order.append(np.array(at)[i])
                cell.append(c)
                home.append(c == own[i])
            at = pa.array(np.concatenate(order))
            yield pa.RecordBatch.from_arrays([b.column("block").take(at), b.column("id").take(at), vectors.take(at), pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(home))], names=["block", "id", "embedding", "cell", "home"])

    return rows.select("block", "id", "embedding").mapInArrow(visits, f"block string, id {kind}, embedding array<{element}>, cell int, home boolean")


def similar_pairs(rows: DataFrame, threshold: float, *, tile: int = 1024, pivots: int = MOST_PIVOTS) -> DataFrame:
    """(block, a, b, similarity), a < b, of pairs of one block with a cosine of at least ``threshold``; ``rows``: block, id, embedding. Exact.

    Inside a cell, visitors meet residents and residents each other, in tiles.
    """
    kind = rows.schema["id"].dataType.simpleString()
    placed = placed_rows(rows, threshold, tile=tile, pivots=pivots)
    per = placed.groupBy("block", "cell").agg(F.ceil(F.count_if("home") / tile).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / tile).cast("int").alias("guests"))
    dealt = placed.join(per.where("homes > 0"), ["block", "cell"])
    # Residents go to their row of tiles on both sides, visitors to one column.
    own = F.pmod(F.xxhash64("id"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    dealt = dealt.withColumn("own", own)
    low = lambda a, b: F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    with_homes = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: low(F.col("own"), o))
    with_guests = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda g: F.struct(F.col("own").alias("x"), (-1 - g).alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: F.struct(o.alias("x"), (-1 - F.col("own")).alias("y")))
    dealt = dealt.withColumn("p", F.explode(F.when(F.col("home"), F.concat(with_homes, with_guests)).otherwise(as_guest))).select("block", "cell", "p.x", "p.y", "own", "home", "id", "embedding")

    def compared(of: pa.Table) -> pa.Table:
        x, y = of.column("x")[0].as_py(), of.column("y")[0].as_py()
        own, home, ids = of.column("own").to_numpy(), of.column("home").to_numpy(), of.column("id").to_numpy()
        v = of.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)
        a, b = home & (own == x), (home & (own == y)) if y >= 0 else ~home
        lengths = np.linalg.norm(v, axis=1)
        near = v[a] @ v[b].T / np.outer(lengths[a], lengths[b])
        i, j = np.nonzero(near >= threshold)
        p, q = ids[a][i], ids[b][j]
        once = p < q if x == y else p != q
        p, q, score = p[once], q[once], near[i, j][once]
        to = of.schema.field("id").type
        return pa.table({"block": pa.array([of.column("block")[0].as_py()] * len(p), pa.string()), "a": pa.array(np.where(p < q, p, q), to), "b": pa.array(np.where(p < q, q, p), to), "similarity": pa.array(score, pa.float64())})

    return dealt.groupBy("block", "cell", "x", "y").applyInArrow(compared, f"block string, a {kind}, b {kind}, similarity double")

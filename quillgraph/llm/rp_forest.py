"""Nearest neighbours by inner product: a forest of random-projection trees and exact reranking.

Hyperplanes are fitted on a bounded sample (``sample`` rows, chosen by hash) and
every row is placed in one leaf of every tree. A query walks all trees through
one priority queue, ordered by the sum of its squared margins to the
hyperplanes on the wrong side of which a leaf lies, and takes leaves until they
hold enough rows. How many that is follows from the sample: the share of rows
after which ``aim`` of the true neighbours have been met. It is small where
rows have neighbours to find, and most of the table where all directions are
alike. Rows of the chosen leaves are then compared exactly. Inner products
become distances by one more coordinate that gives all rows the same length.

Leaves that lie together in a tree form a block; a block of more than ``block``
rows is cut by hash. A task holds the rows of one cut and lets the queries that
asked for one of its leaves stream by, so neither side is sent more often than
it is asked for, and no group grows with the data. Only the nearest of a cut
leave it; they are merged in two steps. The model (hyperplanes and leaf
counts) is bounded by ``most_depth`` and broadcast.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part. Rows that repeat a vec_id are rows of their
own: each is a query or a candidate. A null vec_id is a candidate that comes
last among ties. Ties go to the smaller vec_id. Tables with fewer than two
usable rows give no rows. Further columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, depth: int, top: float, seed: int = 7) -> None:
        self.trees, self.depth, self.top, self.leaves = trees, depth, top, 1 << depth
        rng = np.random.default_rng(seed)
        rows = self.lifted(sample)
        self.normals = rng.standard_normal((trees, self.leaves - 1, rows.shape[1]))
        self.normals /= np.linalg.norm(self.normals, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, self.leaves - 1))
        for t in range(trees):
            at = np.zeros(len(rows), dtype=np.int64)
            for level in range(depth):
                first = (1 << level) - 1
                for node in range(first, 2 * first + 1):
                    here = np.flatnonzero(at == node)
                    side = rows[here] @ self.normals[t, node]
                    self.cuts[t, node] = np.median(side) if len(here) else 0.0
                    at[here] = 2 * node + 1 + (side > self.cuts[t, node])

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with a last coordinate that brings all of them to the length ``top``."""
        rest = np.maximum(self.top**2 - np.einsum("ij,ij->i", x, x), 0.0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): leaf numbers, all trees counted through."""
        rows = self.lifted(x)
        out = np.empty((len(x), self.trees), dtype=np.int32)
        for t in range(self.trees):
            at = np.zeros(len(x), dtype=np.int64)
            side = rows @ self.normals[t].T if self.depth else np.zeros((len(x), 0))
            for _ in range(self.depth):
                at = 2 * at + 1 + (side[np.arange(len(x)), at] > self.cuts[t, at])
            out[:, t] = at - (self.leaves - 1) + t * self.leaves
        return out

    def walk(self, q: np.ndarray, counts: np.ndarray, budget: float) -> list[int]:
        """Leaves in the order of the shared queue until they hold ``budget`` rows."""
        q = np.append(q, 0.0)
        margin = (np.einsum("tnd,d->tn", self.normals, q) - self.cuts).tolist()
        inner, count = self.leaves - 1, counts.tolist()
        heap = [(0.0, t, 0) for t in range(self.trees)]
        out, held = [], 0
        while heap and held < budget:
            far, t, node = heapq.heappop(heap)
            m = margin[t]
            while node < inner:
                side = m[node]
                near = 2 * node + 1 + (side > 0)
                heapq.heappush(heap, (far + side * side, t, 4 * node + 3 - near))
                node = near
            leaf = node - inner + t * self.leaves
            if count[leaf]:
                out.append(leaf)
                held += count[leaf]
        return out


def share_needed(forest: Forest, sample: np.ndarray, k: int, aim: float, queries: int = 400) -> float:
    """Rows to look at, as a share of all, until ``aim`` of the sample's true neighbours have been met."""
    placed = forest.place(sample)
    counts = np.bincount(placed.ravel(), minlength=forest.trees * forest.leaves)
    seen = []
    for i in range(0, len(sample), max(1, len(sample) // queries)):
        scores = sample @ sample[i]
        scores[i] = -math.inf
        best = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        order = forest.walk(sample[i], counts, math.inf)
        rows = np.cumsum(counts[order])
        at = np.full(forest.trees * forest.leaves, np.inf)
        at[order] = rows
        seen.append(at[placed[best]].min(axis=1))
    seen = np.sort(np.concatenate(seen)) if seen else np.array([0.0])
    return float(seen[min(len(seen) - 1, math.ceil(aim * len(seen)))]) / max(1, len(sample))


def depth_for(n: int, leaf: int, most: int) -> int:
    """Levels after which leaves hold about ``leaf`` rows, up to ``most``."""
    return max(0, min(most, math.ceil(math.log2(n / leaf)))) if n > leaf else 0


NO_ID = (1 << 63) - 1  # stands for a null vec_id, which sorts last


def exact_scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed component by component in double precision: the same for equal rows, wherever they stand."""
    out = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        out += rows[:, j] * q[j]
    return out


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), dim)


def _vectors_of(raw: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), dtype=np.float64).reshape(len(raw), dim)


def usable(embeddings: DataFrame) -> tuple[DataFrame, int, int, float]:
    """(row, vec_id, v: array<double>) of the rows that take part, their number, dimension and greatest length."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "forest-rows")
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))")).alias("top")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return rows, 0, 0, 0.0
    return rows.where(F.size("v") == size["d"]), size["n"], size["d"], size["top"]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Cut:
    """The rows of one cut of a block, by leaf."""

    def __init__(self, row: list[int], ids: list[int], raw: list[bytes], leaf: list[int], dim: int) -> None:
        leaf = np.array(leaf)
        order = np.argsort(leaf, kind="stable")
        self.row, self.ids, self.leaf = np.array(row)[order], np.array(ids)[order], leaf[order]
        self.v = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(row), dim)[order]
        self.start = np.flatnonzero(np.r_[True, self.leaf[1:] != self.leaf[:-1]])
        self.place = {int(x): i for i, x in enumerate(self.leaf[self.start])}

    def nearest(self, own: np.ndarray, q: np.ndarray, leaves: list[np.ndarray], k: int):
        """For each query the packed (row, id, score) of its nearest rows in the leaves that it asked for."""
        asked = [[] for _ in self.start]
        for i, x in enumerate(leaves):
            for leaf in x.tolist():
                if (at := self.place.get(leaf)) is not None:
                    asked[at].append(i)
        s = np.full((len(q), len(self.row)), -np.inf)
        for at, (a, b) in enumerate(zip(self.start, np.r_[self.start[1:], len(self.row)], strict=True)):
            if asked[at]:
                s[asked[at], a:b] = q[asked[at]] @ self.v[a:b].T
        for i in range(len(q)):
            line = s[i]
            line[self.row == own[i]] = -np.inf
            at = np.flatnonzero(np.isfinite(line))
            if len(at) > k:
                kth = np.partition(line[at], len(at) - k)[len(at) - k]
                at = at[line[at] >= kth - 1e-9 * max(1.0, abs(kth))]
            exact = exact_scores(q[i], self.v[at])
            best = _best(exact, self.ids[at], k)
            yield tuple(x[best].astype(t).tobytes() for x, t in ((self.row[at], "<i8"), (self.ids[at], "<i8"), (exact, "<f8")))


FOUND = "query long, query_id long, salt int, rows binary, ids binary, scores binary"
#: Queries that are compared with a cut together.
TOGETHER = 256


def _compared(dim: int, k: int, salts: int):
    """Rows sorted by cut, those of the table before the queries: each query's nearest in each cut."""

    def run(batches):
        key, table, cut = None, ([], [], [], []), None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("block", "part", "is_query", "row", "vec_id", "raw", "leaves")]
            out = [[] for _ in range(6)]
            waiting: list[tuple] = []

            def answer():
                if not waiting:
                    return
                own, ids, raw, leaves = zip(*waiting, strict=True)
                waiting.clear()
                q = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(own), dim)
                for o, i, got in zip(own, ids, cut.nearest(np.array(own), q, [np.frombuffer(x, "<i4") for x in leaves], k), strict=True):
                    if got[0]:
                        for c, x in zip(out, (o, i, (key[0] * 31 + key[1]) % salts, *got), strict=True):
                            c.append(x)

            for block, part, is_query, row, vec_id, raw, leaves in zip(*cols, strict=True):
                if (block, part) != key:
                    answer()
                    key, table, cut = (block, part), ([], [], [], []), None
                if not is_query:
                    for c, x in zip(table, (row, vec_id, raw, int.from_bytes(leaves, "little")), strict=True):
                        c.append(x)
                elif table[0]:
                    cut = cut or Cut(*table, dim)
                    waiting.append((row, vec_id, raw, leaves))
                    if len(waiting) == TOGETHER:
                        answer()
            answer()
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["query", "query_id", "salt", "rows", "ids", "scores"])

    return run


def _merged(k: int, final: bool):
    """The nearest of a query over its cuts; a row that several trees found counts once."""

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(4 if final else 5)]
            for query, own, x in zip(b.column("query").to_pylist(), b.column("query_id").to_pylist(), b.column("x").to_pylist(), strict=True):
                rows, first = np.unique(np.frombuffer(b"".join(y["rows"] for y in x), "<i8"), return_index=True)
                ids, scores = np.frombuffer(b"".join(y["ids"] for y in x), "<i8")[first], np.frombuffer(b"".join(y["scores"] for y in x), "<f8")[first]
                best = _best(scores, ids, k)
                if final:
                    for c, v in zip(cols, ([own] * len(best), range(1, len(best) + 1), [i if i != NO_ID else None for i in ids[best].tolist()], scores[best].tolist()), strict=True):
                        c.extend(v)
                else:
                    for c, v in zip(cols, (query, own, rows[best].tobytes(), ids[best].tobytes(), scores[best].tobytes()), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64()) if final else (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            names = ["query_id", "rank", "vec_id", "score"] if final else ["query", "query_id", "rows", "ids", "scores"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def nearest(
    embeddings: DataFrame, *, every: int = 20, k: int = 20, trees: int = 4, leaf: int = 48, most_depth: int = 10,
    sample: int = 8192, aim: float = 0.94, block: int = 16384, report: dict | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, the ``k`` nearest found.

    ``report`` receives the share of the rows that a query's leaves hold, each tree's counted.
    """
    spark = embeddings.sparkSession
    rows, n, dim, top = usable(embeddings)
    out = "query_id long, rank int, vec_id long, score double"
    if n < 2:
        return spark.createDataFrame([], out)
    drawn = rows.orderBy(F.xxhash64("v"), "v").limit(sample).toPandas()
    drawn = np.array(drawn["v"].tolist(), dtype=np.float64)
    depth = depth_for(n, leaf, most_depth)
    forest = Forest(drawn, trees, depth, top)
    share = share_needed(forest, drawn, math.ceil(k * len(drawn) / n), aim)  # as near in the sample as the k nearest are in the table
    model = spark.sparkContext.broadcast(forest)
    if report is not None:
        report["share"] = share

    def place(batches):
        for b in batches:
            at = model.value.place(x := _vectors(b.column("v"), dim))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array(list(at), pa.list_(pa.int32())), pa.array([r.tobytes() for r in x], pa.binary())], names=["row", "vec_id", "at", "raw"])

    placed = written(rows.mapInArrow(place, "row long, vec_id long, at array<int>, raw binary"), "forest-placed")
    counts = np.zeros(trees << depth, dtype=np.int64)
    for r in placed.select(F.explode("at").alias("leaf")).groupBy("leaf").count().collect():  # at most trees x 2^most_depth rows
        counts[r["leaf"]] = r["count"]
    held = spark.sparkContext.broadcast(counts)
    budget = max(share * n, 50 * k)
    # A block is a run of neighbouring leaves with about ``block`` rows.
    wide = 1 << (depth - depth_for(n, block, depth))
    cuts = np.maximum(1, -(-np.add.reduceat(counts, np.arange(0, len(counts), wide)) // block))
    cuts_of = F.element_at(F.array(*(F.lit(int(c)) for c in cuts)), F.col("block") + 1)

    def route(batches):
        for b in batches:
            row, blocks, leaves = [], [], []
            for i, q in enumerate(_vectors_of(b.column("raw"), dim)):
                found = np.sort(np.array(model.value.walk(q, held.value, budget), dtype=np.int32))
                start = np.flatnonzero(np.r_[True, found[1:] // wide != found[:-1] // wide])
                for s, e in zip(start, np.r_[start[1:], len(found)], strict=True):
                    row.append(i)
                    blocks.append(int(found[s]) // wide)
                    leaves.append(found[s:e].astype("<i4").tobytes())
            who = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("row").take(who), b.column("vec_id").take(who), b.column("raw").take(who), pa.array(blocks, pa.int32()), pa.array(leaves, pa.binary())], names=["row", "vec_id", "raw", "block", "leaves"])

    asked = placed.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID)).select("row", "vec_id", "raw").mapInArrow(route, "row long, vec_id long, raw binary, block int, leaves binary")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), cuts_of - 1)))
    table = placed.select("row", "vec_id", "raw", F.explode("at").alias("leaf")).select("*", F.floor(F.col("leaf") / wide).cast("int").alias("block"))
    low = F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright("leaf", 8 * i).bitwiseAND(255)), 2, "0") for i in range(4))))  # four bytes, little end first
    table = table.select("*", low.alias("leaves"), F.pmod(F.xxhash64("row"), cuts_of).cast("int").alias("part"))
    cols = ["block", "part", "is_query", "row", "vec_id", "raw", "leaves"]
    both = table.withColumn("is_query", F.lit(False)).select(cols).unionByName(asked.withColumn("is_query", F.lit(True)).select(cols))
    both = both.repartition("block", "part").sortWithinPartitions("block", "part", "is_query")
    salts = max(1, math.isqrt(int(cuts.sum())))
    found = both.mapInArrow(_compared(dim, k, salts), FOUND)
    entry = F.collect_list(F.struct("rows", "ids", "scores")).alias("x")
    found = found.groupBy("query", "query_id", "salt").agg(entry).drop("salt").mapInArrow(_merged(k, False), FOUND.replace("salt int, ", ""))
    return found.groupBy("query", "query_id").agg(entry).mapInArrow(_merged(k, True), out)

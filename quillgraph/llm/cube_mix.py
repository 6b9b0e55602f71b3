"""Mixing sources to target weights by balanced (cube) sampling.

Every source gets a target number of words; a document of it is taken
floor(ratio) times for certain and once more with the fractional probability.
The fractional part is drawn by the cube method: inclusion probabilities move
along the null space of the balancing constraints (document totals and word
totals), so both totals stay at their expectation until at most two documents
of a block are undecided. Blocks are formed by hash, never by source alone, so
a hot source is spread; undecided documents go up to wider blocks until one
block a source is left, whose last one or two documents are landed on the side
nearest to the target.

Null or empty text has size 0 and is taken 0 words of. A null source is a
source of its own, ordered last. Rows with equal doc_id, source and text are
one unit; of its n rows as many as the expected number, rounded down, are taken
once more for certain, and at most one is left to the draw, so copies come as
near to the target as different rows. Empty input gives no rows. Decisions depend
on the rows alone: reruns agree. Further columns are kept by
``mixed_documents``; names that start with ``_mix_`` are ours.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, number_copies, partitions, row_key, text_of, written

LIMIT = 3.0  # a target stops at so many times its source's size
BLOCK = 4096  # documents a flight block holds on average
EPS = 1e-9


def unit_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size): size is the number of words."""
    return docs.select("doc_id", "source", row_key("doc_id", "source", "text").alias("key"), F.regexp_count(text_of("text"), F.lit(WORD)).cast("long").alias("size"))


def ranked(per: DataFrame) -> DataFrame:
    """``per`` with the rank of each source by code point, null last: ranges of sources are counted and then numbered apart."""
    null = F.col("source").isNull()
    parts = written(per.repartitionByRange(partitions(per.sparkSession), null, "source").withColumn("_mix_part", F.spark_partition_id()), "cube-sources")
    # A row a partition comes together for the sums.
    sizes = parts.groupBy("_mix_part").count()
    before = sizes.select("_mix_part", (F.sum("count").over(Window.orderBy("_mix_part")) - F.col("count")).alias("_mix_before"))
    own = F.row_number().over(Window.partitionBy("_mix_part").orderBy(null, "source"))
    return parts.join(before, "_mix_part").withColumn("rank", F.col("_mix_before") + own - 1).drop("_mix_part", "_mix_before")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = LIMIT) -> DataFrame:
    """(source, source_size, n_docs, target). ``sizes``: source, size.

    Targets share the total by weight; one that would pass ``limit`` times its
    source's size stops there and the rest is shared again. The common level
    (target by weight) only rises as sources stop, so each round is one
    aggregate over the sources, until no more stop.
    """
    per = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = written(per.withColumn("weight", weight), "cube-ranked")
    stop = F.col("source_size") * limit / F.col("weight")
    level, stopped = -1.0, -1
    while True:
        under = stop < F.lit(level)
        row = per.agg(F.sum("source_size").alias("total"), F.sum(F.when(under, F.col("source_size") * limit)).alias("stopped"), F.sum(F.when(~under, F.col("weight"))).alias("open"), F.count(F.when(under, 1)).alias("n")).first()
        if row["n"] == stopped or not row["open"]:
            break
        stopped, level = row["n"], (row["total"] - (row["stopped"] or 0.0)) / row["open"]
    target = F.least(F.col("source_size") * limit, F.lit(max(level, 0.0)) * F.col("weight"))
    return per.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def draws(keys: np.ndarray) -> np.ndarray:
    """A uniform number in (0, 1) for each hex key."""
    return (np.array([int(k[:13], 16) for k in keys], dtype=np.float64) + 0.5) / 16.0**13


def fly(prob: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase: returns probabilities of which at most two are not 0 or 1.

    Three undecided units and two constraints (sums of 1 and of size) leave one
    direction, the cross product of the constraint rows.
    """
    p = prob.tolist()
    s = size.tolist()
    d = draw.tolist()
    open_: list[int] = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = down = math.inf
        for x, v in ((a, u[0]), (b, u[1]), (c, u[2])):
            if v > 0:
                up, down = min(up, (1 - p[x]) / v), min(down, p[x] / v)
            elif v < 0:
                up, down = min(up, p[x] / -v), min(down, (1 - p[x]) / -v)
        step = up if d[i] * (up + down) < down else -down
        for x, v in ((a, u[0]), (b, u[1]), (c, u[2])):
            p[x] += step * v
            if p[x] < EPS:
                p[x] = 0.0
            elif p[x] > 1 - EPS:
                p[x] = 1.0
        open_ = [x for x in open_ if 0.0 < p[x] < 1.0]
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last undecided units: of all ends, the one whose words come nearest to the expected ones."""
    at = [i for i in range(len(prob)) if 0.0 < prob[i] < 1.0]
    want = sum(prob[i] * size[i] for i in at)
    best = min(range(1 << len(at)), key=lambda m: (abs(sum(size[i] for j, i in enumerate(at) if m >> j & 1) - want), abs(bin(m).count("1") - sum(prob[i] for i in at)), m))
    out = prob.copy()
    for j, i in enumerate(at):
        out[i] = best >> j & 1
    return out


def _flight(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
        size = pdf["size"].to_numpy(dtype=np.float64)
        p = fly(pdf["prob"].to_numpy(dtype=np.float64), size, draws(pdf["key"].to_numpy()))
        pdf["prob"] = land(p, size) if last else p
        return pdf[["doc_id", "source", "key", "size", "n", "ratio", "prob"]]

    return run


UNIT = "doc_id long, source string, key string, size long, n long, ratio double, prob double"


def decide(units: DataFrame, most_docs: int, *, block: int = BLOCK) -> DataFrame:
    """``units`` (UNIT columns plus n_docs, the units of their source) with prob moved to 0 or 1.

    ``most_docs``: units of the largest source; it sets the number of levels.
    """
    decided, level, width = None, units, block
    while True:
        last = most_docs <= width
        # A source that fits one block is decided at once, also at a lower level.
        count = F.greatest(F.ceil(F.col("n_docs") / F.lit(float(width))), F.lit(1))
        part = F.pmod(F.xxhash64("key"), count)
        grouped = level.withColumn("part", part).withColumn("alone", count == 1)
        flown = grouped.where("not alone").groupBy("source", "part").applyInPandas(_flight(False), UNIT)
        landed = grouped.where("alone").groupBy("source", "part").applyInPandas(_flight(True), UNIT)
        done = landed if last else written(landed.unionByName(flown), "cube-level")
        ready = done.where("prob = 0 or prob = 1")
        decided = ready if decided is None else decided.unionByName(ready)
        if last:
            return decided
        # At most two of some `block` units go up, so a block of the next level spans so many more units.
        width *= block // 2
        level = done.where("prob > 0 and prob < 1").join(units.select("key", "n_docs"), "key")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, source, key, size, first, n, source_size, target, copies: each of the ``n`` rows of that key from number ``first`` is taken ``copies`` times.

    Distinct rows have one row here; of repeated rows, some may be taken once more than the others.
    """
    units = written(unit_sizes(docs).groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n")), "cube-units")
    goal = written(targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), weights=weights, limit=limit), "cube-targets")
    goal_cols = goal.select(F.col("source").alias("_s"), "source_size", "n_docs", "target")
    rows = units.join(goal_cols, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("ratio", F.least(ratio, F.lit(limit)))
    more = F.col("n") * (F.col("ratio") - F.floor("ratio"))  # rows of the unit that are to be taken once more
    rows = rows.select("doc_id", "source", "key", "size", "n", "ratio", (more - F.floor(more)).alias("prob"), "n_docs")
    most = goal.agg(F.max("n_docs")).first()[0] or 0
    done = decide(rows, most, block=block)
    done = done.withColumn("more", (F.floor(more) + F.col("prob")).cast("long")).withColumn("base", F.floor("ratio").cast("long"))
    part = lambda first, n, copies: F.struct(first.alias("first"), n.alias("n"), copies.alias("copies"))
    parts = F.array(part(F.lit(1).cast("long"), F.col("more"), F.col("base") + 1), part(F.col("more") + 1, F.col("n") - F.col("more"), F.col("base")))
    done = done.select("doc_id", "source", "key", "size", F.explode(F.filter(parts, lambda x: x["n"] > 0)).alias("p"))
    return done.join(goal_cols, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "key", "size", "p.first", "p.n", "source_size", "target", "p.copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    chosen = mix(docs, **options).select(F.col("key").alias("_mix_key"), F.col("first").alias("_mix_first"), F.col("n").alias("_mix_n"), F.col("copies").alias("_mix_copies"))
    chosen = written(chosen, "cube-chosen")
    keyed = docs.withColumn("_mix_key", row_key("doc_id", "source", "text"))
    many = chosen.where("_mix_first > 1 or _mix_n > 1").select("_mix_key").distinct()
    if many.isEmpty():
        taken = keyed.join(chosen.where("_mix_copies > 0"), "_mix_key")
    else:
        once = keyed.join(many, "_mix_key", "left_anti").withColumn("_mix_ordinal", F.lit(1).cast("long"))
        copies = number_copies(keyed.join(many, "_mix_key", "left_semi"), "_mix_key", "_mix_ordinal")
        inside = F.col("_mix_ordinal").between(F.col("_mix_first"), F.col("_mix_first") + F.col("_mix_n") - 1)
        taken = once.unionByName(copies).join(chosen.where("_mix_copies > 0"), "_mix_key").where(inside)
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*docs.columns)

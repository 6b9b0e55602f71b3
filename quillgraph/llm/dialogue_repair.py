"""Conversation structure repair as weighted finite-state composition.

A conversation's rows in order of turn are an input acceptor; each row is a
symbol: the initial of its role and its first fault (blank, duplicate of an
earlier row, truncated). An edit transducer rewrites it: K keeps a row (0), R
gives it the role user or assistant (2), D deletes it (3, and the only edit of
a blank or duplicate row), I inserts an empty row of user or assistant (2);
truncated rows that stay add 1. A grammar acceptor reads the roles that come
out: nothing, or ``s?(ua)+``. The three are composed lazily, state by state
from those that can be entered, and a shortest path is taken in topological
order (row, inserts in the gap, grammar state) over weights (cost, labels)
that compare by cost and then by label string. Two inserts in a gap suffice: a
third would close a cycle of the grammar.

Rows are dealt by ranges of (conversation, turn, role, text) and numbered in
that order, so a conversation may lie in any number of tasks. Each run of up
to ``CHUNK`` rows becomes a matrix of weights from grammar state to grammar
state; matrices of a conversation are multiplied in a tree. That is exact: of
two label strings of equal cost over the same rows neither begins the other,
since what is left would be inserts, which cost. Only the audit string, one
letter an edit, is one value a conversation, because it is asked for so.

Nulls are read as one space (role, text) and sort first (turn); a null
conversation id is a conversation of its own. Rows of equal turn follow by
role and text. An empty table gives no rows. Repeated rows are duplicates of
the first. Texts of any length are read whole; further columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

#: Rows a matrix at most (a power of two), and matrices multiplied by one task at a time.
CHUNK, FAN = 1024, 64
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
GOOD, BLANK, DUPLICATE, TRUNCATED = "0123"
LEGAL = ("su", "ua", "au")
SHOWN = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


class Repaired(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    report: DataFrame
    #: conv_id, place, sub (order inside the conversation), edit, role, text.
    rows: DataFrame


def edits(role: str, fault: str):
    """(label, cost, role that comes out or None) of a row."""
    yield "D", 3, None
    if fault in (GOOD, TRUNCATED):
        more = int(fault == TRUNCATED)
        yield "K", more, role
        for to in ROLES:
            yield "R", 2 + more, to


@functools.lru_cache(maxsize=100_000)
def weights(symbols: str, entries: tuple[int, ...], exits: tuple[int, ...]) -> dict[tuple[int, int], tuple[int, str]]:
    """(entry, exit) -> least (cost, labels) over the rows; pairs without a path are left out.

    ``symbols`` has two characters a row. States of the composition are (row,
    inserts made in the gap before it, grammar state); only those reached from
    ``entries`` are made.
    """
    n = len(symbols) // 2
    made = [[set(entries), set(), set()]]
    for i in range(n + 1):
        for e in (0, 1):
            made[i][e + 1] |= {GRAMMAR[g][r] for g in made[i][e] for r in ROLES if r in GRAMMAR[g]}
        if i < n:
            here = set().union(*made[i])
            went = {g if out is None else GRAMMAR[g].get(out) for g in here for _, _, out in edits(symbols[2 * i], symbols[2 * i + 1])}
            made.append([went - {None}, set(), set()])
    found = {}
    for last in exits:
        after: dict[int, tuple[int, str]] = {}
        for i in range(n, -1, -1):
            if i == n:
                use = {last: (0, "")}
            else:
                use = {}
                for label, cost, out in edits(symbols[2 * i], symbols[2 * i + 1]):
                    for g in set().union(*made[i]):
                        to = after.get(g if out is None else GRAMMAR[g].get(out))
                        if to is not None:
                            w = (to[0] + cost, label + to[1])
                            if g not in use or w < use[g]:
                                use[g] = w
            best = {g: use[g] for g in made[i][2] if g in use}
            for e in (1, 0):
                upper, best = best, {g: use[g] for g in made[i][e] if g in use}
                for g in made[i][e]:
                    for r in ROLES:
                        to = upper.get(GRAMMAR[g].get(r))
                        if to is not None:
                            w = (to[0] + 2, "I" + to[1])
                            if g not in best or w < best[g]:
                                best[g] = w
            after = best
        found.update({(g, last): after[g] for g in entries if g in after})
    return found


def product(left: dict, right: dict) -> dict:
    """Weights of two runs of rows, one behind the other."""
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for (a, b), (cost, labels) in left.items():
        for (c, d), (more, tail) in right.items():
            if b == c:
                w = (cost + more, labels + tail)
                if (a, d) not in out or w < out[a, d]:
                    out[a, d] = w
    return out


_WEIGHTS = pa.schema([("_c", pa.string()), ("k", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("pairs", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("labels", pa.list_(pa.string()))])
_WEIGHTS_DDL = "_c string, k long, first string, last string, illegal long, pairs array<int>, costs array<long>, labels array<string>"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    """(_c, k, first, last, illegal, weights) as columns."""
    cols = [[r[j] for r in rows] for j in range(5)]
    cols.append([[4 * a + b for a, b in r[5]] for r in rows])
    cols.append([[w[0] for w in r[5].values()] for r in rows])
    cols.append([[w[1] for w in r[5].values()] for r in rows])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _WEIGHTS, strict=True)], schema=_WEIGHTS)


def _matrices(batches):
    for b in batches:
        rows = []
        for c, k, total, symbols in zip(*(b.column(x).to_pylist() for x in ("_c", "k", "total", "symbols")), strict=True):
            roles = symbols[::2]
            illegal = sum(x + y not in LEGAL for x, y in zip(roles, roles[1:], strict=False))
            # A conversation in one piece is entered at the start and left where it may end.
            w = weights(symbols, (START,), FINAL) if total == 1 else weights(symbols, (START,) if k == 0 else tuple(GRAMMAR), FINAL if k == total - 1 else tuple(GRAMMAR))
            rows.append((c, k, roles[0], roles[-1], illegal, w))
        yield _packed(rows)


def _multiplied(batches, fan: int):
    """Neighbours of a conversation with equal k div ``fan`` become one row; the rows come in order."""
    held = None
    for b in batches:
        done = []
        for c, k, first, last, illegal, pairs, costs, labels in zip(*(b.column(x.name).to_pylist() for x in _WEIGHTS), strict=True):
            w = {(p // 4, p % 4): x for p, x in zip(pairs, zip(costs, labels, strict=True), strict=True)}
            if held is not None and held[:2] == (c, k // fan):
                illegal += held[4] + (held[3] + first not in LEGAL)
                held = (c, k // fan, held[2], last, illegal, product(held[5], w))
            else:
                done += [held] if held is not None else []
                held = (c, k // fan, first, last, illegal, w)
        if done:
            yield _packed(done)
    if held is not None:
        yield _packed([held])


def _cuts(batches):
    """For each run of rows: the roles inserted before each row, its edit and new role, and the roles inserted behind the last."""
    for b in batches:
        out: list[list] = [[], [], [], [], [], []]
        for c, audit, runs in zip(*(b.column(x).to_pylist() for x in ("_c", "audit", "runs")), strict=True):
            at, state = 0, START
            for r, run in enumerate(runs):
                before, edit, to = [], [], []
                for role in run["symbols"][::2]:
                    made = ""
                    while audit[at] == "I":
                        made += "a" if state == USER else "u"
                        state, at = ASSISTANT if state == USER else USER, at + 1
                    new = "a" if state == USER else "u"
                    if audit[at] != "D":
                        state = GRAMMAR[state][role if audit[at] == "K" else new]
                    before.append(made)
                    edit.append(audit[at])
                    to.append(ROLES[new] if audit[at] == "R" else None)
                    at += 1
                made = ""
                while r == len(runs) - 1 and at < len(audit):
                    made += "a" if state == USER else "u"
                    state, at = ASSISTANT if state == USER else USER, at + 1
                for col, v in zip(out, (c, run["q"], before, edit, to, made), strict=True):
                    col.append(v)
        kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["_c", "q", "before", "edit", "to", "behind"])


def conversation_key(conv_id: str | Column) -> Column:
    c = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows in order of (conversation, turn, role, text), each with its place; a table."""
    spark = rows.sparkSession
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select(conversation_key("conv_id").alias("_c"), "conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    rows = rows.repartitionByRange(partitions(spark), "_c", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("_c", "turn", "role", "text")
    shown = F.col("text").rlike(SHOWN)
    return written(rows.select(
        "*", F.monotonically_increasing_id().alias("place"), F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("same"),
        (~shown).alias("is_blank"), (shown & ~F.col("text").rlike(ENDED)).alias("is_truncated"),
    ), "dialogue-rows")


def repair(rows: DataFrame, *, chunk: int = CHUNK, fan: int = FAN) -> Repaired:
    """The report and the repaired rows of ``rows(conv_id, turn, role, text)``."""
    spark = rows.sparkSession
    run = lambda place: F.shiftright(place, chunk.bit_length() - 1).alias("q")
    table = _numbered(rows)
    slim = table.select("_c", "place", "turn", "same", F.substring("role", 1, 1).alias("initial"), "is_blank", "is_truncated")
    firsts = slim.groupBy("_c", "same").agg(F.min("place").alias("first_place"))
    fault = F.when(F.col("is_blank"), BLANK).when(F.col("place") > F.col("first_place"), DUPLICATE).when(F.col("is_truncated"), TRUNCATED).otherwise(GOOD)
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("?")
    marked = slim.join(firsts, ["_c", "same"]).select("_c", "place", "turn", F.concat(role, fault).alias("symbol"), fault.alias("fault"))
    count = lambda f: F.sum((F.col("fault") == f).cast("long"))
    runs = written(marked.groupBy("_c", run("place")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"), F.min("place").alias("start"),
        count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"),
    ), "dialogue-runs")
    ends = table.groupBy("_c").agg(F.first("conv_id").alias("conv_id"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.coalesce(F.least(wide("high") - wide("low") + 1 - wide("n"), F.lit(2**63 - 1).cast("decimal(38,0)")), F.lit(0)).cast("long")
    over = "(PARTITION BY _c)"
    parts = runs.selectExpr("_c", "symbols", f"row_number() OVER {over[:-1]} ORDER BY q) - 1 AS k", f"count(*) OVER {over} AS total")
    done = parts.select("_c", F.col("k").cast("long"), "total", "symbols").mapInArrow(_matrices, _WEIGHTS_DDL)
    most = parts.agg(F.max("k")).first()[0] or 0
    while most:
        most //= fan
        done = done.repartition(partitions(spark), "_c", F.expr(f"k DIV {fan}")).sortWithinPartitions("_c", "k").mapInArrow(lambda batches: _multiplied(batches, fan), _WEIGHTS_DDL)
    zipped = F.filter(F.arrays_zip("pairs", "costs", "labels"), lambda x: x["pairs"].isin(*(4 * START + f for f in FINAL)))
    best = F.array_min(F.transform(zipped, lambda x: F.struct(x["costs"].alias("cost"), x["labels"].alias("audit"))))
    solved = written(done.select("_c", "illegal", best.alias("best")).select("_c", "illegal", "best.cost", "best.audit"), "dialogue-audits")
    faults = runs.groupBy("_c").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    report = ends.select("_c", "conv_id", gaps.alias("gaps")).join(faults, "_c").join(solved, "_c").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    listed = runs.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("q", "symbols"))).alias("runs"))
    cuts = solved.join(listed, "_c").select("_c", "audit", "runs").mapInArrow(_cuts, "_c string, q long, before array<string>, edit array<string>, to array<string>, behind string")
    cuts = cuts.join(runs.select("_c", "q", "start"), ["_c", "q"])
    i = (F.col("place") - F.col("start")).cast("int")
    row = F.struct(F.get("edit", i).alias("edit"), F.coalesce(F.get("to", i), F.col("role")).alias("role"), F.col("text").alias("text"))
    named = lambda x: F.struct(F.lit("I").alias("edit"), F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text"))
    inserted = lambda s: F.transform(F.filter(F.split(s, ""), lambda x: x != ""), named)
    behind = F.when(i == F.size("edit") - 1, F.col("behind")).otherwise("")
    kept = F.when(F.get("edit", i) == "D", F.array().cast("array<struct<edit:string,role:string,text:string>>")).otherwise(F.array(row))
    joined = table.withColumn("q", run("place")).join(cuts, ["_c", "q"])
    whole = joined.select("conv_id", "place", F.posexplode(F.concat(inserted(F.get("before", i)), kept, inserted(behind))).alias("sub", "x"))
    return Repaired(report, whole.select("conv_id", "place", "sub", "x.edit", "x.role", "x.text"))


def digests(rows: DataFrame) -> DataFrame:
    """(_c, repaired_sha256): the hash of each conversation's ``role:text`` lines in order, streamed row by row."""

    def run(batches):
        held, h = None, None
        for b in batches:
            names, sums = [], []
            for c, line in zip(b.column("_c").to_pylist(), b.column("line").to_pylist(), strict=True):
                if c != held:
                    if held is not None:
                        names.append(held)
                        sums.append(h.hexdigest())
                    held, h = c, hashlib.sha256(line.encode())
                else:
                    h.update(b"\n" + line.encode())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums)], names=["_c", "repaired_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([h.hexdigest()])], names=["_c", "repaired_sha256"])

    lines = rows.select(conversation_key("conv_id").alias("_c"), "place", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    sorted_ = lines.repartition(partitions(rows.sparkSession), "_c").sortWithinPartitions("_c", "place", "sub")
    return sorted_.select("_c", "line").mapInArrow(run, "_c string, repaired_sha256 string")

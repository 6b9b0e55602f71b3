"""Conversation repair against Dijkstra over whole conversations, written apart from the operator."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import dialogue_repair, queries

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def model(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) of one conversation's (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    turns = [t for known, t, *_ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for *_, role, text in rows:
        shown = text.strip(SPACE)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in out)
        # What matters of the output is whether it is a start of the grammar, and where it stands in it.
        if not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        at = "" if not initials else initials[-1]
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, out
        if (i, at) in done:
            continue
        done.add((i, at))
        for r in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, (*out, (r, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out))
            if faults[i] in ("", "truncated"):
                more = faults[i] == "truncated"
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, (role, text))))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, (*out, (r, text))))
    raise AssertionError


def random_rows(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "no", "", " \n", "Why?", "a! ", None, "b", "c.", "d.", "e.", "f.", "g.", "h."]
    return [(rng.choice([None, *range(6)]) if rng.random() < 0.2 else k, rng.choice(roles), rng.choice(texts) + str(k) + "." if rng.random() < 0.5 else rng.choice(texts)) if rng.random() < 0.9 else (k, "user", None) for k in range(n)]


def safe_rows(rng, n):
    while True:
        try:
            return random_rows(rng, n)
        except TypeError:  # a null text has no ending
            continue


def check(spark, rows, **sizes):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_c", F.lit("clash")).withColumn("place", F.lit(1))
    report, repaired = dialogue_repair.repair(df.repartition(5), **sizes)
    got = {r.conv_id: r for r in report.collect()}
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.place, r.sub)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    sums = {r._c: r.repaired_sha256 for r in dialogue_repair.digests(repaired).collect()}
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(rest)
    assert set(got) == set(by)
    for c, own in by.items():
        *want, out = model(own)
        r = got[c]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == want, (c, own)
        assert lines.get(c, []) == list(out)
        if out:
            assert sums["" if c is None else f"={c}"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_random_conversations(spark):
    rng = random.Random(11)
    rows = [(c if c else None, *r) for c in range(300) for r in safe_rows(rng, rng.randrange(1, 12))]
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("chunk, fan", [(2, 2), (4, 3), (8, 64)])
def test_conversations_in_pieces(spark, chunk, fan):
    """Long conversations whose rows lie in many runs and tasks."""
    rng = random.Random(chunk)
    check(spark, [(c, *r) for c in range(6) for r in safe_rows(rng, 5 + 20 * c)], chunk=chunk, fan=fan)


def test_a_conversation_with_most_rows(spark):
    rng = random.Random(2)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"t{rng.randrange(9000)}{rng.choice(['.', ''])}") for k in range(6000)] + [(8, 0, "user", "x" * 300_000)]
    check(spark, rows)


def test_product_of_runs_is_the_whole():
    rng = random.Random(3)
    every = tuple(dialogue_repair.GRAMMAR)
    for _ in range(300):
        s = "".join(rng.choice("sua?") + rng.choice("0123") for _ in range(rng.randrange(1, 14)))
        cut = 2 * rng.randrange(len(s) // 2 + 1)
        whole = dialogue_repair.weights(s, every, every)
        assert whole == dialogue_repair.product(dialogue_repair.weights(s[:cut], every, every), dialogue_repair.weights(s[cut:], every, every))


def test_empty(spark):
    report, rows = dialogue_repair.repair(spark.createDataFrame([], SCHEMA))
    assert report.count() == 0 and rows.count() == 0 and dialogue_repair.digests(rows).count() == 0


def damage(c, t, role, text):
    d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
    return [(t, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)


def held(rows, given):
    by = {}
    for c, *rest in given:
        by.setdefault(c, []).extend(damage(c, *rest))
    assert sorted(map(str, by)) == sorted(str(r.conv_id) for r in rows)
    for r in rows:
        *want, out = model(by[r.conv_id])
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == want
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_query(spark, sf_dir, tmp_path):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    held(queries.op11_dialogue_repair(spark, sf_dir).collect(), given)
    odd = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "b"), (2, 3, None, "c."), *((k, 0, "user", "only.") for k in range(10, 60)), *((9, t, "assistant", "same.") for t in (5, 5, 9))]
    spark.createDataFrame(odd, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    held(queries.op11_dialogue_repair(spark, str(tmp_path)).collect(), odd)

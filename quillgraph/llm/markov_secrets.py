"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order models over 67 characters are trained on labelled samples that
no pattern of the scan has made: random strings of four alphabets, ``RANDOM``
of each, from a hash of their number (hexadecimal ones are left to the fixed
pattern); and ordinary runs of ``FORMS`` forms: identifiers in snake, camel,
kebab and upper case, paths, file names and versions, dates and dated paths,
telephone and book numbers, UUIDs, rulers of one character, alphabets. They are
made of neighbouring words of ``SAMPLE`` documents drawn by hash, at most
``TRIPLES`` of each, and of digits of a hash of the words. One sample in five,
by hash, is held out of the training. A run of at least ``RUN`` such characters
outside the fixed spans is reported as ``markov`` if its log-likelihood ratio
passes ``THRESHOLD``, and ``EACH`` times its length. Only built-in functions run on
the executors; the driver gets the transition counts, at most 2 x 68 x 67 numbers.

Texts of any length are read whole. Spans are code points, end exclusive, of the whole match. Null text is empty;
empty tables give no rows; repeated rows are scanned one by one. Further
columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: The kinds in their order, and the method's own.
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN = 16  # characters of a run that is compared
BLOCK = 256  # spans whose offsets are summed together
UNIT = 1000  # log ratios are whole numbers of 1/1000 nat
THRESHOLD, EACH = 12 * UNIT, 5 * UNIT // 4  # of the run, and a character


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
ASSIGN = rf"({KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the same spans as runs of any length of which the short ones are dropped
CHARS = rf"[A-Za-z0-9+/_=-]{{{RUN},}}"
PRIOR = 10.0  # weight, in characters, of the single-character model behind the ordinary one
RANDOM, SAMPLE, TRIPLES, LENGTH = 1000, 2000, 25, 40
FORMS = 18
RULERS = "-=_+/xX0-=_ab9z-"  # a character for each hexadecimal digit
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2
PIECE = "[A-Za-z]{3,12}"


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<s, e, v>> of all matches: offsets from the lengths of the matches and of what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    parts = F.filter(F.zip_with(F.zip_with(gaps, found, lambda g, f: F.struct(F.length(g).alias("g"), F.length(f).alias("f"))), value, lambda x, v: F.struct(x["g"].alias("g"), x["f"].alias("f"), v.alias("v"))), lambda x: x["f"].isNotNull())
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    length = lambda x: x["g"] + x["f"]

    def placed(block: Column, at: Column) -> Column:
        """Spans of a block of parts that begins at offset ``at``."""
        step = lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + length(x)).alias("e"), x["v"].alias("v")))).alias("out"))
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def all_placed(p: Column) -> Column:
        # Arrays grow by copying, so offsets are summed in blocks: a text with a million matches stays affordable.
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,b:array<struct<g:int,f:int,v:string>>>>").alias("out"))
        step = lambda acc, b: F.struct((acc["at"] + F.aggregate(b, F.lit(0), lambda s, x: s + length(x))).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), b.alias("b")))).alias("out"))
        return F.flatten(F.transform(F.aggregate(blocks, start, step, lambda acc: acc["out"]), lambda x: placed(x["b"], x["at"])))

    return F.when(F.size(found) > 0, F.transform(F.array(parts), all_placed)[0]).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, runs): spans of the fixed patterns, and the runs outside them."""
    t = F.col("_t")
    rows = docs.select("doc_id", text_of("text").alias("_t")).select(
        "doc_id",
        F.filter(spans(t, ASSIGN, 2), lambda x: F.length(x["v"]) >= 12).alias("assign"),
        F.filter(spans(t, ACCESS), lambda x: F.length(x["v"]) >= 18).alias("access"),
        spans(t, HEX).alias("hex"),
        spans(t, CHARS).alias("runs"),
    )
    # Access and hex spans lie inside one run each, so the run's own characters tell.
    inside = lambda r: r["v"].rlike(rf"{HEX}|AKIA[A-Z0-9]{{14,}}")
    apart = F.filter("runs", lambda r: ~inside(r) & ~F.exists("assign", lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])))
    return rows.withColumn("runs", apart)


def forms() -> list[str]:
    """The forms of ordinary runs, as SQL over words a, b, c, their number i, and hexadecimal (h) and decimal (g) digits."""
    g = lambda s, n: f"substr(g, {s}, {n})"
    h = lambda s, n: f"substr(h, {s}, {n})"
    cap = lambda c: f"upper(substr({c}, 1, 1)), substr({c}, 2)"
    letters = f"substr('{LETTERS}', i % 26 + 1, 24)"
    return [f"concat({x})" for x in (
        "a, '_', b, '_', c", f"a, {cap('b')}, {cap('c')}", "a, '-', b, '-', c", "upper(a), '_', upper(b), '_', upper(c)", "a, '/', b, '/', c, CAST(i AS STRING)",
        f"{g(1, 4)}, '-', {g(5, 2)}, '-', {g(7, 2)}, '-', {g(9, 2)}, '-', {g(11, 2)}, '-', {g(13, 2)}",
        f"'/', {g(1, 4)}, '/', {g(5, 2)}, '/', {g(7, 2)}, '/', a, '-', b, '-', {g(9, 6)}",
        f"'+', {g(1, 2)}, '-', {g(3, 3)}, '-', {g(6, 8)}, '-', {g(14, 2)}",
        f"{h(1, 8)}, '-', {h(9, 4)}, '-', {h(13, 4)}, '-', {h(17, 4)}, '-', {h(21, 12)}",
        f"repeat(substr('{RULERS}', instr('0123456789abcdef', substr(h, 1, 1)), 1), 24)",
        f"'/', a, '/', b, {g(1, 1)}, '/', c, '_', {g(2, 4)}", f"a, '_', b, '_', {g(1, 8)}, '_', {g(9, 4)}",
        f"a, '-', {g(1, 1)}, '/', b, '-', {g(2, 4)}, '-', {g(6, 1)}, '/', c, {g(7, 4)}",
        f"CASE WHEN i % 2 = 1 THEN {letters} ELSE lower({letters}) END", f"upper(a), '_', upper(b), {g(1, 4)}, '_', upper(c)", f"a, {cap('b')}, {g(1, 3)}, {cap('c')}",
        "upper(a), upper(b), upper(c)", f"upper(substr(a, 1, 3)), {cap('b')}, {cap('c')}",
    )]


def samples(docs: DataFrame) -> DataFrame:
    """(random, v, held): labelled samples; ``held`` marks those kept out of the training."""
    n = F.col("id").cast("string")
    b64 = F.base64(F.unhex(F.sha2(n, 256)))
    plain = F.translate(b64, "+/=", "xYz")
    kinds = F.array(*(F.substring(c, 1, LENGTH) for c in (b64, plain, F.upper(plain), F.lower(plain))))
    random = docs.sparkSession.range(RANDOM).select(F.lit(True).alias("random"), F.explode(kinds).alias("v"))
    # Rows whose hash is low enough for some four times the sample, so that few texts come together to be ordered.
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\u0001"), F.col("t")))
    drawn = docs.select("doc_id", text_of("text").alias("t")).select(key.alias("key"), "t")
    if (rows := docs.count()) > 4 * SAMPLE:
        drawn = drawn.where(F.substring("key", 1, 8) < f"{int(4294967296.0 * 4 * SAMPLE / rows):08x}")
    drawn = drawn.dropDuplicates(["key"]).orderBy("key").limit(SAMPLE)
    w = F.transform(F.regexp_extract_all("t", F.lit(PIECE), F.lit(0)), lambda x: F.lower(x))
    i = F.col("i")
    triples = drawn.select(w.alias("w")).where(F.size("w") >= 3).select("w", F.explode(F.sequence(F.lit(0), F.least(F.floor(F.size("w") / 3), F.lit(TRIPLES)).cast("int") - 1)).alias("i"))
    triples = triples.select("i", *(F.col("w")[3 * i + k].alias(c) for k, c in enumerate("abc")))
    triples = triples.withColumn("h", F.md5(F.concat("a", "b", "c", F.col("i").cast("string")))).withColumn("g", F.translate("h", "abcdef", "012345"))
    ordinary = triples.select(F.lit(False).alias("random"), F.element_at(F.array(*(F.expr(f) for f in forms())), i % FORMS + 1).alias("v"))
    return random.unionByName(ordinary).withColumn("held", F.substring(F.md5("v"), 1, 1).isin("0", "5", "a"))


def transitions(labelled: DataFrame) -> DataFrame:
    """(random, prev, next, n): counts over the samples that are not held out; prev 0 is the start, a character its place from 1."""
    rows = labelled.where("not held").select("random", F.transform(F.split("v", ""), place).alias("c"))
    rows = rows.select("random", F.explode(F.zip_with(F.concat(F.array(F.lit(0)), F.slice("c", 1, F.size("c") - 1)), "c", lambda a, b: a * 1000 + b)).alias("step"))
    return rows.groupBy("random", "step").agg(F.count("*").alias("n")).select("random", F.floor(F.col("step") / 1000).cast("int").alias("prev"), (F.col("step") % 1000).alias("next"), "n")


def place(ch: Column) -> Column:
    return F.call_function("locate", ch, F.lit(ALPHABET), F.lit(1))


def log_ratios(counts: list[tuple[bool, int, int, int]]) -> list[int]:
    """ln P(next | prev, random) - ln P(next | prev, ordinary); row prev, column next - 1.

    Random strings are smoothed towards even characters, ordinary ones towards
    how often each character is, so a character that identifiers hardly use
    speaks for a random string after any other.
    """
    k = len(ALPHABET)
    n = {True: [[0] * k for _ in range(k + 1)], False: [[0] * k for _ in range(k + 1)]}
    for random, prev, nxt, c in counts:
        n[random][prev][nxt - 1] = c
    single = [sum(row[nxt] for row in n[False]) for nxt in range(k)]
    share = [(c + 0.5) / (sum(single) + 0.5 * k) for c in single]
    out = []
    for prev in range(k + 1):
        r, o = n[True][prev], n[False][prev]
        for nxt in range(k):
            out.append(math.floor(UNIT * (math.log((r[nxt] + 1) / (sum(r) + k)) - math.log((o[nxt] + PRIOR * share[nxt]) / (sum(o) + PRIOR))) + 0.5))
    return out


def score(run: Column, table: Column) -> Column:
    """Log-likelihood ratio of a run, in whole units."""
    k = len(ALPHABET)
    start = F.struct(F.lit(0).alias("prev"), F.lit(0).cast("long").alias("sum"))
    step = lambda acc, ch: F.struct(place(ch).alias("prev"), (acc["sum"] + F.element_at(table, acc["prev"] * k + place(ch))).alias("sum"))
    return F.aggregate(F.split(run, ""), start, step, lambda acc: acc["sum"])


def trained(docs: DataFrame) -> Column:
    """The log ratios of the models trained for ``docs``, as an array literal."""
    counts = [tuple(r) for r in transitions(samples(docs)).collect()]
    return F.split(F.lit(",".join(map(str, log_ratios(counts)))), ",").cast("array<bigint>")


def find_secrets(docs: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    table = trained(docs)
    rows = written(scan(docs), "secret-spans").withColumn("markov", F.filter("runs", lambda x: score(x["v"], table) > F.greatest(F.lit(threshold), EACH * F.length(x["v"]))))
    as_kind = lambda c, k: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    listed = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.concat(*(as_kind(k, i) for i, k in enumerate(KINDS[:3])))
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.concat(base, as_kind("markov", 3))).alias("spans"), size("markov").alias("n_markov"),
    )


def oracle() -> str:
    """The same result in DuckDB's SQL, model included."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    k = len(ALPHABET)

    def find(kind: str, pattern: str, group: int) -> str:
        return f"""(SELECT r, '{kind}' AS kind, gs, ms, unnest(range(1, len(ms) + 1)) AS i, vs FROM (
            SELECT r, string_split_regex(t, {q(pattern)}) AS gs, regexp_extract_all(t, {q(pattern)}) AS ms, regexp_extract_all(t, {q(pattern)}, {group}) AS vs FROM d) x)"""

    ordinary = " ".join(f"WHEN {n} THEN {f}" for n, f in enumerate(forms()))
    found = " UNION ALL ".join(f"SELECT * FROM {find(*x)}" for x in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("run", CHARS, 0)))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m0 AS ({found}),
m AS (SELECT r, kind, vs[i] AS v, (coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS s,
      length(ms[i])::BIGINT AS n FROM m0),
sp AS (SELECT r, kind, v, s, s + n AS e FROM m WHERE (kind = 'assign' AND length(v) >= 12) OR (kind = 'access' AND n >= 18) OR kind IN ('hex', 'run')),
base AS (SELECT * FROM sp WHERE kind <> 'run'),
runs AS (SELECT x.* FROM sp x WHERE kind = 'run' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = x.r AND b.s < x.e AND x.s < b.e)),
steps AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE instr('{ALPHABET}', v[i-1:i-1]) END AS prev, instr('{ALPHABET}', v[i:i]) AS next FROM (SELECT r, s, v, unnest(range(1, length(v) + 1)) AS i FROM runs) y),
b64 AS (SELECT x.x AS n, base64(unhex(sha256(CAST(x.x AS VARCHAR)))) AS e, translate(base64(unhex(sha256(CAST(x.x AS VARCHAR)))), '+/=', 'xYz') AS p FROM range(0, {RANDOM}) x(x)),
tr AS (SELECT w, unnest(range(0, least(len(w) // 3, {TRIPLES}))) AS i FROM (
  SELECT list_transform(regexp_extract_all(t, {q(PIECE)}), lambda x: lower(x)) AS w FROM (
    SELECT md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(1) || t) AS key, any_value(t) AS t FROM d GROUP BY 1) k, (SELECT count(*) AS n FROM d) c
    WHERE n <= 4 * {SAMPLE} OR key[1:8] < lpad(lower(to_hex(CAST(floor(4294967296.0::DOUBLE * 4 * {SAMPLE} / n) AS BIGINT))), 8, '0') ORDER BY key LIMIT {SAMPLE}) x WHERE len(w) >= 3),
tw0 AS (SELECT i, w[3*i+1] AS a, w[3*i+2] AS b, w[3*i+3] AS c, md5(w[3*i+1] || w[3*i+2] || w[3*i+3] || i) AS h FROM tr),
tw AS (SELECT *, translate(h, 'abcdef', '012345') AS g FROM tw0),
samples AS (SELECT true AS random, substr(unnest([e, p, upper(p), lower(p)]), 1, {LENGTH}) AS v FROM b64
  UNION ALL SELECT false, CASE i % {FORMS} {ordinary} END FROM tw),
ss AS (SELECT random, v, unnest(range(1, length(v) + 1)) AS i FROM samples WHERE md5(v)[1] NOT IN ('0', '5', 'a')),
c AS (SELECT random, prev, next, count(*) AS n FROM (SELECT random, CASE WHEN i = 1 THEN 0 ELSE instr('{ALPHABET}', v[i-1:i-1]) END AS prev, instr('{ALPHABET}', v[i:i]) AS next FROM ss) y GROUP BY 1, 2, 3),
sg AS (SELECT n.n AS next, (coalesce(sum(c.n), 0) + 0.5::DOUBLE) / (coalesce((SELECT sum(n) FROM c WHERE NOT random), 0) + 0.5::DOUBLE * {k}) AS share FROM range(1, {k + 1}) n(n) LEFT JOIN c ON c.next = n.n AND NOT c.random GROUP BY 1),
grid AS (SELECT p.p AS prev, n.n AS next FROM range(0, {k + 1}) p(p), range(1, {k + 1}) n(n)),
lr AS (SELECT prev, next, floor({UNIT} * (ln((coalesce(rn, 0) + 1)::DOUBLE / (sum(coalesce(rn, 0)) OVER (PARTITION BY prev) + {k})) - ln((coalesce(on_, 0) + {PRIOR}::DOUBLE * share) / (sum(coalesce(on_, 0)) OVER (PARTITION BY prev) + {PRIOR}::DOUBLE))) + 0.5)::BIGINT AS llr
  FROM grid JOIN sg USING (next) LEFT JOIN (SELECT prev, next, n AS rn FROM c WHERE random) a USING (prev, next) LEFT JOIN (SELECT prev, next, n AS on_ FROM c WHERE NOT random) b USING (prev, next)),
mk AS (SELECT r, 'markov' AS kind, any_value(v) AS v, s, any_value(s + length(v)) AS e FROM steps JOIN lr USING (prev, next) GROUP BY r, s HAVING sum(llr) > greatest({THRESHOLD}, {EACH} * any_value(length(v)))),
allsp AS (SELECT r, kind, s, e FROM base UNION ALL SELECT r, kind, s, e FROM mk),
named AS (SELECT r, kind, s, e, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END AS k, kind || ':' || s || ':' || e AS txt FROM allsp),
g AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'markov') AS n_markov,
  string_agg(txt, ',' ORDER BY s, k) FILTER (kind <> 'markov') AS b, string_agg(txt, ',' ORDER BY s, k) AS a FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_markov, 0)::BIGINT AS n_markov
FROM d LEFT JOIN g USING (r)"""

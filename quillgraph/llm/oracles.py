"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from . import adaptive_quality as quality
from . import collocations, cover_dedup, extendible, markov_secrets


def url_filter(rules, junk) -> str:
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    return f"""
WITH p AS (SELECT page_id, row_number() OVER () AS r, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, r, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM p),
rules(verdict, h, pre) AS (VALUES {values}),
fit AS (SELECT r, arg_max(struct_pack(rule := h || pre, verdict := verdict), length(h || pre) * 1000 + length(h)) AS x
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY r),
c AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html)?/*$', '') AS canonical_url FROM s),
listed AS (SELECT DISTINCT canonical_url AS u FROM c WHERE regexp_matches(host, '^((www|m)\\.)?({"|".join(junk)})\\.') AND canonical_url <> '')
SELECT page_id, host, path, x.rule AS rule,
  coalesce(x.verdict, CASE WHEN canonical_url IN (SELECT u FROM listed) THEN 'block' ELSE 'allow' END) AS verdict, canonical_url,
  (x IS NULL AND canonical_url IN (SELECT u FROM listed)) AS listed
FROM c LEFT JOIN fit USING (r)"""


def sharding(limit: int) -> str:
    bits = extendible.BITS
    digits = bits // 4
    nibble = "['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']"
    return f"""
WITH RECURSIVE u0 AS (SELECT doc_id, md5(coalesce(CAST(doc_id AS VARCHAR), chr(0)) || chr(1) || coalesce(text, chr(0))) AS k, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
u1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k) AS o FROM u0),
u AS (SELECT doc_id, n_bytes, row_number() OVER () AS r, array_to_string(list_transform(range(1, {digits + 1}), lambda i: {nibble}[instr('0123456789abcdef', substr(md5(k || ':' || o), i, 1))]), '') AS h FROM u1),
sums AS (SELECT d.d AS depth, substr(h, 1, d.d) AS shard, sum(n_bytes) AS b, count(*) AS c FROM u, range(0, 21) d(d) GROUP BY 1, 2),
leaf AS (SELECT s.* FROM sums s LEFT JOIN sums p ON p.depth = s.depth - 1 AND p.shard = substr(s.shard, 1, s.depth - 1)
  WHERE (s.b <= {limit} OR s.c = 1) AND (s.depth = 0 OR NOT (p.b <= {limit} OR p.c = 1)))
SELECT doc_id, n_bytes, shard, CAST(depth AS INT) AS depth, CAST(b AS BIGINT) AS shard_bytes FROM u JOIN leaf ON substr(h, 1, depth) = shard"""


def quality_stats(table: str = "documents") -> str:
    """CTEs ``w`` (words and lines a row) and ``st`` (the statistics)."""
    return f"""
d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM {table}),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3) x),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) x WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k.k) AS n_repeat_words FROM rep, range(0, 3) k(k) GROUP BY r),
st0 AS (SELECT r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
st AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM st0)"""


def quality_rules() -> str:
    sub, reach, prior = quality.SUB, quality.REACH, quality.PRIOR
    per = lambda c, half: f"10000 * (2 * {c} + {half}) // (2 * greatest(n_words, 1))"
    counted = {"symbol_rate": "n_symbols", "dup_line_rate": "n_dup_lines", "repeat_rate": "n_repeat_words"}
    length = {"word_length": "100 * word_chars // greatest(n_words, 1)"}
    rate = {m: per(c, 0) for m, c in counted.items()} | length
    sketched = {m: per(c, 1) for m, c in counted.items()} | length
    rows = " UNION ALL ".join(f"SELECT r, lang, source, '{m}' AS metric, {x} AS v FROM st WHERE NOT base_failed" for m, x in sketched.items())
    # The least value of a bucket is the value with all but its leading bits cleared.
    low = lambda v: f"CASE WHEN {v} < {1 << sub} THEN {v} ELSE ({v} >> (length(bin({v})) - {1 + sub})) << (length(bin({v})) - {1 + sub}) END"
    level = lambda k: "CASE metric " + " ".join(f"WHEN '{m}' THEN {p[k]}" for m, p in quality.LEVELS.items()) + " END"

    def quantiles(name: str, keys: str) -> str:
        group = keys + ", " if keys else ""
        over = f"PARTITION BY {group}metric"
        return f"""{name} AS (SELECT {group}metric, CAST(max(n) AS BIGINT) AS n, min(b) FILTER (run * 100 >= n * {level(0)}) AS lo, min(b) FILTER (run * 100 >= n * {level(1)}) AS hi FROM (
  SELECT {group}metric, b, sum(c) OVER ({over} ORDER BY b) AS run, sum(c) OVER ({over}) AS n FROM (SELECT {group}metric, b, count(*) AS c FROM v GROUP BY {group}metric, b) x) y GROUP BY {group}metric)"""

    drawn = lambda q: f"(a.n * a.{q} + {prior} * ((l.n * l.{q} + {prior} * e.{q}) // (l.n + {prior}))) // (a.n + {prior})"
    tests = " AND ".join([*(f"({low(f'({x})')}) <= most['{m}']" for m, x in rate.items()), f"({low('(' + rate['word_length'] + ')')}) >= least['word_length']"])
    return f"""
WITH {quality_stats()},
v0 AS ({rows}), v AS (SELECT *, {low("v")} AS b FROM v0),
{quantiles('a', 'lang, source')}, {quantiles('l', 'lang')}, {quantiles('e', '')},
q AS (SELECT a.lang, a.source, a.metric, {drawn('lo')} AS lo, {drawn('hi')} AS hi
  FROM a JOIN l ON a.metric = l.metric AND a.lang IS NOT DISTINCT FROM l.lang JOIN e ON a.metric = e.metric),
f AS (SELECT lang, source, map_from_entries(list((metric, hi + {reach} * (hi - lo)))) AS most, map_from_entries(list((metric, lo - {reach} * (hi - lo)))) AS least FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({tests}, false) AS kept
FROM st LEFT JOIN f ON st.lang IS NOT DISTINCT FROM f.lang AND st.source IS NOT DISTINCT FROM f.source"""


def substring_dedup() -> str:
    w = cover_dedup.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i+{w - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {w - 2})) AS i FROM d WHERE len(ws) >= {w}) x),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM g) x WHERE c > 1),
cov AS (SELECT DISTINCT r, i + k.k AS p FROM rep, range(0, {w}) k(k)),
gone AS (SELECT r, list(p) AS ps, count(*) AS n FROM cov GROUP BY r),
word AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.p) AS txt FROM word LEFT JOIN cov ON cov.r = word.r AND cov.p = word.p WHERE cov.p IS NULL GROUP BY word.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)"""


def phrases() -> str:
    c = collocations
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS ws FROM d),
g AS (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, range(1, {c.LONGEST + 1}) x(m) WHERE len(ws) >= m),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
cand AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= {c.LEAST}),
cut AS (SELECT lang, phrase, f, ws, unnest(range(1, m)) AS k FROM cand),
scored AS (SELECT cut.lang, cut.phrase, k, l.f AS l, r.f AS r, (CAST(cut.f AS HUGEINT) * {c.SCALE}) // (l.f + r.f) AS score FROM cut
  JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(ws[1:k], ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(ws[k + 1:], ' ')),
low AS (SELECT lang, phrase, min(struct_pack(score := score, k := k, l := l, r := r)) AS b FROM scored GROUP BY lang, phrase),
part AS (SELECT lang, f, m, ws, s, unnest(range(1, m - s + 2)) AS i FROM cand, range(2, {c.LONGEST}) x(s) WHERE s < m),
around AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(f) AS f FROM part GROUP BY ALL),
kept AS (SELECT cand.lang, cand.phrase, cand.f AS a, b.l AS l, b.r AS r, CAST(b.score AS BIGINT) AS score FROM cand JOIN low ON low.lang = cand.lang AND low.phrase = cand.phrase
  LEFT JOIN around ON around.lang = cand.lang AND around.phrase = cand.phrase WHERE around.f IS NULL OR 100 * CAST(around.f AS HUGEINT) < {c.COVERED_PERCENT} * CAST(cand.f AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) x JOIN n USING (lang) WHERE rank <= {c.TOP}"""


def statements(rules, junk, shard_bytes) -> dict[str, str]:
    return {
        "op1_url_filter": url_filter(rules, junk),
        "op4_quality_rules": quality_rules(),
        "op6_sharding": sharding(shard_bytes),
        "op8_secret_scan": markov_secrets.oracle(),
        "op10_substring_dedup": substring_dedup(),
        "op12_collocations": phrases(),
    }

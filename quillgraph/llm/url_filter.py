"""URL filtering: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 512-bit blocks (eight longs). A URL probes one block,
so the probe is an equi-join on the block number; the blocks are broadcast only
while their number stays under ``max_broadcast_blocks`` (72 bytes each), else
they are joined by shuffle. Possible hits go on to an exact hash join with the
list, which removes the false positives.

Nulls: a null URL, or one without ``://``, has an empty host and path, fits no
rule, is on no list and is allowed. Repeated rows are judged one by one and all
returned. An empty list allows whatever no rule blocks. Further columns of the
input are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # longs in a block


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first ``://`` up to ``/ ? #``, and from there up to ``? #``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, and the path without ``.html`` or slashes at its end."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(text, verdict); the longer host wins a tie; null if none fits."""
    fits = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        hit = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        fits = F.when(hit, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(fits)
    return fits


def _places(url: Column, blocks: int, k: int) -> tuple[Column, list[Column]]:
    """Block number and the k bit numbers (0..511) of a URL."""
    h1, h2 = F.xxhash64(url), F.xxhash64(url, F.lit(1))
    bits = [F.shiftrightunsigned(h2, 9 * i).bitwiseAND(511).cast("int") for i in range(min(k, 7))]
    return F.pmod(h1, F.lit(blocks)), bits


def bloom_blocks(listed: DataFrame, url: str, blocks: int, k: int = 6) -> DataFrame:
    """(block, w0..w7) of a blocked Bloom filter over ``listed[url]``."""
    block, bits = _places(F.col(url), blocks, k)
    rows = listed.select(block.alias("block"), F.array(*bits).alias("bits"))
    word = lambda w: F.aggregate(
        "bits", F.lit(0).cast("long"),
        lambda acc, b: F.when(F.floor(b / 64) == w, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64))).otherwise(acc),
    )
    return rows.select("block", *(word(w).alias(f"w{w}") for w in range(WORDS))).groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], *, bits_per_key: int = 16, k: int = 6, max_broadcast_blocks: int = 1 << 17) -> DataFrame:
    """Judge ``pages(page_id, url)``; ``listed(url)`` holds canonical URLs to block.

    Returns page_id, host, path, rule, verdict, canonical_url, maybe_listed
    (the Bloom filter's answer) and listed (the exact one).
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    fits = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", fits.alias("_rule"), canonical(F.col("host"), F.col("path")).alias("canonical_url"))
    keys = listed.select(F.col("url").alias("_listed")).where("_listed is not null and _listed <> ''").distinct()
    blocks = max(1, math.ceil(keys.count() * bits_per_key / 512))
    filt = bloom_blocks(keys, "_listed", blocks, k)
    if blocks <= max_broadcast_blocks:
        filt = F.broadcast(filt)
    block, bits = _places(F.col("canonical_url"), blocks, k)
    rows = rows.withColumn("block", F.when(F.col("_rule").isNull(), block))
    rows = rows.join(filt, "block", "left")
    hit = F.lit(True)
    for b in bits:
        w = F.element_at(F.array(*(F.col(f"w{i}") for i in range(WORDS))), (F.floor(b / 64) + 1).cast("int"))
        hit = hit & (F.call_function("getbit", w, b % 64) == 1)
    rows = rows.select("page_id", "host", "path", "_rule", "canonical_url", F.coalesce(F.col("w0").isNotNull() & hit, F.lit(False)).alias("maybe_listed"))
    # Only possible hits carry a key into the exact join; the rest have null and stay where they are.
    maybe = rows.where("maybe_listed").join(keys, F.col("canonical_url") == F.col("_listed"), "left").withColumn("listed", F.col("_listed").isNotNull()).drop("_listed")
    rest = rows.where("not maybe_listed").withColumn("listed", F.lit(False))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return maybe.unionByName(rest).select("page_id", "host", "path", F.col("_rule.text").alias("rule"), verdict.alias("verdict"), "canonical_url", "maybe_listed", "listed")

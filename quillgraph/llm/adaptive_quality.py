"""Quality rules with thresholds that follow each language and source.

Statistics of a text are computed by built-in functions alone. Their
distribution is kept in mergeable quantile sketches: integer histograms with
relative-error buckets (128 to an octave), which add up over partitions, over
sources to languages and over languages to the corpus, in any order, with the
same result. A threshold is a fence outside two quantiles of the documents of
the same language and source, as far again as ``REACH`` times their distance.
No threshold is fixed and none has a least room: the quantiles of a group are
drawn towards those of its language, and these towards the corpus, as if
``PRIOR`` documents of the wider group had been seen with it, so small groups
are judged too. Most documents have none of what a rate counts, so rates are
sketched with half an occurrence more in each document: what a text of its
length may well have, which differs from document to document and is never 0.
A document is judged by its plain rate, so one without any passes.
Documents are then filtered by a join with the thresholds.

Null text has no words and fails the base rules. A null lang or source is a
group of its own. Repeated rows count and are judged one by one. Empty tables
give no rows. Further columns are kept by ``filter_documents``; names that
start with ``_q_`` are ours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, text_of, words, written

SUB = 7  # bits of a bucket's mantissa: 128 buckets to an octave
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: What is sketched, with the percents between which a group's documents count as ordinary: rates in 1 of
#: 10,000 words (word length in 1/100 characters). Rates are mostly 0, so their upper quantile lies far out.
LEVELS = {"symbol_rate": (50, 90), "dup_line_rate": (50, 98), "repeat_rate": (50, 98), "word_length": (25, 75)}
METRICS = tuple(LEVELS)
REACH = 3  # quantile distances
PRIOR = 200  # documents
POS_BITS = 21  # positions beside the hash in a sort key


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column) -> Column:
    """Words of the array ``w`` inside a 3-word window that occurs twice or more.

    Windows are sorted by a key of 43 hash bits and 21 position bits; equal
    neighbours are compared word by word. A text in which different windows
    share hash bits, or with 2^21 words, is sorted by the windows themselves.
    """
    n = F.size(w)
    window = lambda w, i: F.concat_ws(" ", F.slice(w, i + 1, 3))
    low = F.lit((1 << POS_BITS) - 1).cast("long")

    def covered(starts: Column) -> Column:
        """Words covered by windows at the increasing ``starts``."""
        return let(starts, lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(
            F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p)), lambda a, b: F.least(b - a, F.lit(3).cast("long"))), F.lit(3).cast("long"), lambda acc, x: acc + x)))

    def marked(pairs: Column) -> Column:
        """Positions, increasing, of both sides of equal neighbours: pairs of (a, b) or null."""
        return F.array_sort(F.array_distinct(F.flatten(pairs)))

    def by_hash(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))

        def found(k: Column) -> Column:
            near = F.filter(
                F.zip_with(F.slice(k, 1, F.size(k) - 1), F.slice(k, 2, F.size(k)), lambda a, b: F.when(F.shiftright(a, POS_BITS) == F.shiftright(b, POS_BITS), F.array(a.bitwiseAND(low), b.bitwiseAND(low)))),
                lambda x: x.isNotNull(),
            )

            def verified(pairs: Column) -> Column:
                same = F.forall(pairs, lambda x: (w[x[0].cast("int")] == w[x[1].cast("int")]) & (w[x[0].cast("int") + 1] == w[x[1].cast("int") + 1]) & (w[x[0].cast("int") + 2] == w[x[1].cast("int") + 2]))
                return F.when(same, covered(marked(pairs)))

            return let(near, verified)

        return let(F.sort_array(keys), found)

    def by_text(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(window(w, i).alias("t"), i.cast("long").alias("i")))

        def found(k: Column) -> Column:
            return covered(marked(F.filter(
                F.zip_with(F.slice(k, 1, F.size(k) - 1), F.slice(k, 2, F.size(k)), lambda a, b: F.when(a["t"] == b["t"], F.array(a["i"], b["i"]))),
                lambda x: x.isNotNull(),
            )))

        return let(F.array_sort(keys), found)

    def both(w: Column) -> Column:
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).when(F.size(w) >= 1 << POS_BITS, by_text(w)).otherwise(F.coalesce(by_hash(w), by_text(w)))

    return let(w, both)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.col("_q_text")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    docs = docs.withColumn("_q_text", text_of(text)).withColumns({"_q_words": words("_q_text"), "_q_lines": lines})
    docs = docs.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_q_words")),
    }).drop("_q_text", "_q_words", "_q_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.withColumn("base_failed", failed)


def rates(*, half: bool = False) -> dict[str, Column]:
    """The metrics of a document; ``half``: with half an occurrence more, as they are sketched."""
    whole = lambda a, b: F.expr(f"cast({a} as bigint) div cast({b} as bigint)")
    rate = lambda c: whole(f"10000 * (2 * {c} + {int(half)})", "2 * greatest(n_words, 1)")
    return {"symbol_rate": rate("n_symbols"), "dup_line_rate": rate("n_dup_lines"), "repeat_rate": rate("n_repeat_words"), "word_length": whole("100 * word_chars", "greatest(n_words, 1)")}


def bucket(v: Column) -> Column:
    """Bucket of an integer: itself below 2^SUB, then as many to each octave, by integer arithmetic."""
    e = F.length(F.bin(v)) - 1
    shift = F.greatest(e - SUB, F.lit(0))
    return F.when(v < 1 << SUB, v).otherwise((shift + 1).cast("long") * (1 << SUB) + F.call_function("shiftright", v, shift.cast("int")) - (1 << SUB))


def bucket_value(b: Column) -> Column:
    """The smallest integer of a bucket."""
    octave = F.floor(b / (1 << SUB)).cast("long")
    return F.when(b < 1 << SUB, b).otherwise(F.call_function("shiftleft", b % (1 << SUB) + (1 << SUB), (octave - 1).cast("int")))


def sketches(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, metric, bucket, n): the sketch of each group, over documents that pass the base rules."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), bucket(v).alias("bucket")) for m, v in rates(half=True).items()))
    rows = stats.where("not base_failed").select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("p"))
    return rows.groupBy("lang", "source", "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, n, lo, hi) at the levels of each metric. A sketch has at most some thousand buckets, so a group's array is bounded."""
    per = sketch.groupBy(*keys, "metric").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bucket", F.col("n").alias("c")))).alias("cells"))

    def at(k: int) -> Column:
        # The first bucket whose running count reaches the level; whole numbers only.
        percent = F.element_at(F.create_map(*(F.lit(x) for m, p in LEVELS.items() for x in (m, p[k]))), F.col("metric"))
        start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(None).cast("long").alias("hit"))
        step = lambda acc, x: F.struct((acc["run"] + x["c"]).alias("run"), F.coalesce(acc["hit"], F.when((acc["run"] + x["c"]) * 100 >= F.col("n") * percent, x["bucket"])).alias("hit"))
        return bucket_value(F.aggregate("cells", start, step, lambda acc: acc["hit"]))

    return per.select(*keys, "metric", "n", at(0).alias("lo"), at(1).alias("hi"))


def thresholds(sketch: DataFrame, *, prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """(lang, source, metric, least, most): fences of every group seen; ``least`` is null for the rates."""
    own = quantiles(sketch, "lang", "source")
    langs = quantiles(merged(sketch, "lang"), "lang").select(F.col("lang").alias("_l"), "metric", F.col("n").alias("n_l"), F.col("lo").alias("lo_l"), F.col("hi").alias("hi_l"))
    every = quantiles(merged(sketch)).select("metric", F.col("lo").alias("lo_e"), F.col("hi").alias("hi_e"))  # a row a metric
    rows = own.join(langs, F.col("lang").eqNullSafe(F.col("_l")) & (own["metric"] == langs["metric"])).drop(langs["metric"]).join(every, "metric")
    drawn = lambda q: F.expr(f"(n * {q} + {prior} * ((n_l * {q}_l + {prior} * {q}_e) div (n_l + {prior}))) div (n + {prior})")
    rows = rows.select("lang", "source", "metric", drawn("lo").alias("lo"), drawn("hi").alias("hi"))
    room = reach * (F.col("hi") - F.col("lo"))
    return rows.select("lang", "source", "metric", F.when(F.col("metric") == "word_length", F.col("lo") - room).alias("least"), (F.col("hi") + room).alias("most"))


def judge(stats: DataFrame, fences: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``stats`` with ``kept``. A group without a document that passes the base rules has no fences and keeps nothing."""
    by = F.map_from_entries(F.collect_list(F.struct("metric", F.struct("least", "most"))))
    f = fences.groupBy(F.col("lang").alias("_q_l"), F.col("source").alias("_q_s")).agg(by.alias("_q_f"))
    rows = stats.join(f, F.col(lang).eqNullSafe(F.col("_q_l")) & F.col(source).eqNullSafe(F.col("_q_s")), "left")
    ok = F.lit(True)
    for m, v in rates().items():
        fence, v = F.element_at("_q_f", F.lit(m)), bucket_value(bucket(v))  # no finer than what the sketch tells apart
        ok = ok & (v <= fence["most"]) & (fence["least"].isNull() | (v >= fence["least"]))
    kept = ~F.col("base_failed") & F.coalesce(ok, F.lit(False))
    return rows.withColumn("kept", kept).drop("_q_l", "_q_s", "_q_f")


def score_documents(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, the statistics, base_failed and kept."""
    stats = written(statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"), "quality-stats")
    fences = written(thresholds(sketches(stats)), "quality-fences")
    return judge(stats, fences).drop("lang", "source")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns (of any names: they travel as one struct)."""
    rows = docs.select(F.struct("*").alias("_q_row"), "lang", "source", "text")
    stats = written(statistics(rows).drop("text"), "quality-rows")
    fences = written(thresholds(sketches(stats)), "quality-fences")
    return judge(stats, fences).where("kept").select("_q_row.*")

"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is a sequence of k-mers of ``K`` words, each labelled with its
occurrence number. Each of ``BANDS`` sketches takes the ``ELL`` labelled k-mers
of least hash and keeps them in text order, so texts agree on a sketch only if
they share these k-mers in the same order. Texts that agree on a sketch form a
bucket, and any two members of a bucket are compared, or are of one class
already, whatever the size of the bucket:

1. Buckets of more than a tile are compared with one hub first, the member that
   shares most buckets with others. That joins most copies of a hot text to one
   class, with work in proportion to the members.
2. Then every member outside the largest class of its bucket meets all members
   of other classes. Members travel in tiles, one row for each pair of tiles, so
   a hot bucket is many tasks. A member goes to every tile on the other side,
   so of n members that stay unlike n * n / ``TILE`` rows travel; copies of one
   text are few after step 1. A pair is looked at in the first bucket that it shares. Within a pair
   of tiles, what has been joined is not compared again, and only links that
   join something leave the task.

A pair is accepted if its sets of k-mers have a Jaccard similarity of at least
``SIMILAR`` and a banded alignment of the words matches at least that share of
the longer text. Accepted pairs are joined to classes. Texts with equal words
are one node from the start and are not expanded.

Alignments take memory in proportion to the texts: bit vectors have ``WIDTH``
bits, and long texts are first aligned through words that occur once in both.
Null and empty texts are nobody's duplicate. Texts of under ``K`` words have
one k-mer, all their words. The class id is the smallest doc_id of the class
(null only if no member has one). Repeated rows fall in one class. Empty tables
give no rows. Further columns, of any name but those that start with ``_omh_``,
are kept by ``keep_one`` and not read by ``near_duplicates``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, mixed, text_of, window_hashes, written
from .components import connected

K, SIMILAR, BANDS, ELL = 5, 0.8, 16, 3
LOW = 64  # least k-mer hashes kept for the estimate before alignment
SURE = 0.55  # pairs estimated below this are at least five deviations under SIMILAR
WIDTH, GAP = 4096, 2048  # words of a bit vector, and of a stretch between anchors, at most
TILE = 512  # members of a bucket that travel together
TILE_BYTES = 4 << 20  # of word hashes that travel together
SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(tokens: list[bytes]) -> bytes:
    """16 bytes that name a word sequence."""
    return hashlib.md5(b" ".join(tokens)).digest()


def kmers(h: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers of a text's word hashes."""
    return window_hashes(h, min(K, len(h)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """BANDS hashes; each is over ELL labelled k-mers in text order and its own band."""
    n = len(shingles)
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    occurrence = np.empty(n, dtype=np.uint64)
    occurrence[order] = np.arange(n, dtype=np.uint64) - np.repeat(start, np.diff(np.r_[start, n])).astype(np.uint64)
    labelled = mixed(shingles + occurrence * np.uint64(0xD6E8FEB86659FD93))
    take = min(ELL, n)
    # One multiplication and one shift a band: the labelled hashes are mixed already.
    v = (labelled[None, :] ^ SEEDS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0x94D049BB133111EB)
    at = np.argpartition(v, take - 1, axis=1)[:, :take] if n > take else np.tile(np.arange(n), (BANDS, 1))
    at.sort(axis=1)
    out = SEEDS.copy()
    for k in range(take):
        out = mixed(out ^ labelled[at[:, k]])
    return out


def _sketches(batches):
    hashes = WordHashes()
    for b in batches:
        fps, sizes, weights, sigs, lows = [], [], [], [], []
        for t in b.column("text").cast(pa.binary()).to_pylist():
            tokens = t.split()
            if not tokens:
                for x in (fps, sizes, weights, sigs, lows):
                    x.append(None)
                continue
            sh = kmers(hashes.of(tokens))
            distinct = np.unique(sh)
            fps.append(fingerprint(tokens))
            sizes.append(len(distinct))
            weights.append(len(tokens))
            sigs.append(sketch(sh).view(np.int64))
            lows.append((distinct[:LOW] >> np.uint64(32)).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("th"), pa.array(fps, pa.binary()), pa.array(sizes, pa.int32()), pa.array(weights, pa.int32()), pa.array(sigs, pa.list_(pa.int64())), pa.array(lows, pa.binary())],
            names=["doc_id", "th", "fp", "size", "n_words", "sig", "low"],
        )


def _word_hashes(batches):
    """Word hashes of the texts that are wanted; a row whose words are not those of ``fp`` shares only its key."""
    hashes = WordHashes()
    for b in batches:
        fps, out = [], []
        for t, fp in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("fp").to_pylist(), strict=True):
            tokens = t.split()
            if fingerprint(tokens) == fp:
                fps.append(fp)
                out.append(hashes.of(tokens).astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(out, pa.binary())], names=["fp", "data"])


def estimates(low: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities from the least hashes; exact where both texts have at most LOW k-mers."""
    lengths = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    starts = np.cumsum(lengths) - lengths
    both = np.add.reduceat(np.isin(flat, low), starts)
    # Beyond the end of a full list nothing is known of that text.
    theirs = np.add.reduceat(flat <= low[-1], starts) if len(low) == LOW else lengths
    ends = np.array([x[-1] for x in others])
    mine = np.where(lengths == LOW, np.searchsorted(low, ends, side="right"), len(low))
    return both / np.maximum(1, mine + theirs - both)


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(words of the common head and tail, what lies between them in ``a`` and in ``b``)."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1]) if n else []
    tail = int(differ[0]) if len(differ) else n
    return head + tail, a[: len(a) - tail], b[: len(b) - tail]


def plain_words(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Words matched by the best alignment within ``band`` of the diagonal: the longest common subsequence, bit by bit."""
    done, a, b = trimmed(a, b)
    if not len(a) or not len(b):
        return done
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    window = (1 << (2 * band + 1)) - 1
    v = full
    for j, x in enumerate(b.tolist()):
        m = where.get(x)
        if m is None:
            continue
        m &= window << (j - band) if j >= band else window >> (band - j)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return done + len(a) - v.bit_count()


def aligned_words(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """``plain_words`` in blocks of ``WIDTH`` words of ``a``: bit vectors of that width, and a carry bit for each word of ``b``."""
    done, a, b = trimmed(a, b)
    if len(a) <= WIDTH:
        return done + plain_words(a, b, band)
    words = b.tolist()
    carry, total = np.zeros(len(b), dtype=bool), 0
    for start in range(0, len(a), WIDTH):
        block = a[start : start + WIDTH].tolist()
        where: dict[int, int] = {}
        for i, x in enumerate(block):
            where[x] = where.get(x, 0) | 1 << i
        full = (1 << len(block)) - 1
        # Rows whose band meets the block, and those that a carry comes in at.
        low, high = max(0, start - band), min(len(b), start + len(block) + band)
        rows = np.concatenate([np.flatnonzero(carry[:low]), np.arange(low, max(low, high)), max(low, high) + np.flatnonzero(carry[max(low, high) :])])
        v, out = full, np.zeros(len(b), dtype=bool)
        came = carry.tolist()
        for j in rows.tolist():
            m = where.get(words[j], 0)
            if m:
                left, right = j - band - start, j + band - start  # the band, in bits of the block
                if left > 0:
                    m = m >> left << left
                if right < len(block) - 1:
                    m &= (1 << right + 1) - 1 if right >= 0 else 0
            if not m and not came[j]:
                continue
            u = v & m
            s = v + u + came[j]
            v = (s | (v - u)) & full
            out[j] = s > full
        total += len(block) - v.bit_count()
        carry = out
    return done + total


def anchored_words(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Words matched by an alignment through anchors: no more than the best one's.

    Anchors are k-mers that occur once in each text, inside the band, on the
    longest chain that rises in both; short stretches between them are aligned.
    """
    done, a, b = trimmed(a, b)
    if min(len(a), len(b)) < K:
        return done + plain_words(a, b, band) if min(len(a), len(b)) and max(len(a), len(b)) <= WIDTH else done
    (ha, ia, na), (hb, ib, nb) = (np.unique(window_hashes(x, K), return_index=True, return_counts=True) for x in (a, b))
    ha, ia, hb, ib = ha[na == 1], ia[na == 1], hb[nb == 1], ib[nb == 1]
    _, x, y = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    pairs = np.stack([ia[x], ib[y]], axis=1)
    pairs = pairs[np.abs(pairs[:, 0] - pairs[:, 1]) <= band]
    pairs = pairs[np.argsort(pairs[:, 0])]
    tops: list[int] = []
    held: list[int] = []
    back = np.full(len(pairs), -1, dtype=np.int64)
    for k, j in enumerate(pairs[:, 1].tolist()):
        at = bisect_left(tops, j)
        back[k] = held[at - 1] if at else -1
        if at == len(tops):
            tops.append(j)
            held.append(k)
        else:
            tops[at], held[at] = j, k
    chain = []
    k = held[-1] if held else -1
    while k >= 0:
        chain.append(k)
        k = int(back[k])
    found, i, j = 0, 0, 0
    ends = [*pairs[chain[::-1]].tolist(), [len(a), len(b)]]
    for p, q in ends:
        skip = max(i - p, j - q, 0)
        if not skip and p > i and q > j and max(p - i, q - j) <= GAP and max(p - j, q - i) <= band:
            shift = abs(i - j)
            found += plain_words(a[i:p], b[j:q], max(p - i, q - j) + shift)  # the whole stretch lies in the band
        if p < len(a) and skip < K and p + skip >= i:
            found += K - skip
            i, j = p + K, q + K
    return done + found


def aligned(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a banded alignment matches the share ``SIMILAR`` of the longer text's words.

    In long texts, one through anchors that matches as many decides it without the best one.
    """
    most = max(len(a), len(b))
    band = int((1 - SIMILAR) * most) + 1
    if most > WIDTH and anchored_words(a, b, band) >= SIMILAR * most:
        return True
    return aligned_words(a, b, band) >= SIMILAR * most


class Tiles:
    """The members of one row of tiles: which of them ask (``a``), which answer (``b``), and who is to be compared."""

    def __init__(self, val: int, fp: list[bytes], root: list[bytes], out, size, sig, a, b) -> None:
        self.val, self.fp, self.out, self.size, self.sig = val, fp, out, size, sig
        self.asks, self.answers = np.flatnonzero(a), np.flatnonzero(b)
        numbers: dict[bytes, int] = {}
        self.group = np.array([numbers.setdefault(r, len(numbers)) for r in root])
        self.order = np.empty(len(fp), dtype=np.int64)
        self.order[sorted(range(len(fp)), key=fp.__getitem__)] = np.arange(len(fp))

    def partners(self, i: int) -> np.ndarray:
        """Answering members that ``i`` has to be compared with in this bucket."""
        at = self.answers[self.group[self.answers] != self.group[i]]
        # Of two that both ask, one asks the other.
        at = at[~self.out[at] | (self.order[i] < self.order[at])]
        small = np.minimum(self.size[at], self.size[i])
        at = at[small >= SIMILAR * np.maximum(self.size[at], self.size[i])]
        if len(at):
            agree = self.sig[at] == self.sig[i]
            at = at[self.sig[at, np.argmax(agree, axis=1)] == self.val]  # the first bucket that they share
        return at

    def join(self, i: int, j: int) -> None:
        self.group[self.group == self.group[j]] = self.group[i]


def _tiles(batch: pa.RecordBatch):
    """(Tiles, data of its members) of each row."""
    col = batch.column("m")
    ends = np.cumsum(np.r_[0, [len(x) for x in col]])
    cells = col.flatten()
    fp, root, data = (cells.field(x).to_pylist() for x in ("fp", "root", "data"))
    out, a, b = (cells.field(x).to_numpy(zero_copy_only=False) for x in ("out", "a", "b"))
    size = cells.field("size").to_numpy(zero_copy_only=False)
    sig = cells.field("sig").flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    for val, s, e in zip(batch.column("val").to_pylist(), ends, ends[1:], strict=False):
        at = slice(s, e)
        yield Tiles(val, fp[at], root[at], out[at], size[at], sig[at], a[at], b[at]), data[at]


def _promising(batches):
    """Members that some partner resembles by estimate."""
    for batch in batches:
        vals, fps = [], []
        for t, data in _tiles(batch):
            low = [np.frombuffer(x, "<u4") for x in data]
            found = np.zeros(len(low), dtype=bool)
            for i in t.asks:
                at = t.partners(i)
                if len(at):
                    at = at[estimates(low[i], [low[j] for j in at]) >= SURE]
                    found[at] = True
                    found[i] |= len(at) > 0
            here = np.flatnonzero(found)
            vals += [t.val] * len(here)
            fps += [t.fp[i] for i in here]
        yield pa.RecordBatch.from_arrays([pa.array(vals, pa.int64()), pa.array(fps, pa.binary())], names=["val", "fp"])


def _links(batches):
    """Accepted pairs that join classes; those between members that are joined already are left out."""
    for batch in batches:
        left, right = [], []
        for t, data in _tiles(batch):
            word = [np.frombuffer(x, "<u8") for x in data]
            sets: dict[int, np.ndarray] = {}

            def of(i):
                if i not in sets:
                    sets[i] = np.unique(kmers(word[i]))
                return sets[i]

            for i in t.asks:
                at = t.partners(i)
                if not len(at):
                    continue
                theirs = [of(j) for j in at]
                lengths = np.array([len(x) for x in theirs])
                both = np.add.reduceat(np.isin(np.concatenate(theirs), of(i)), np.cumsum(lengths) - lengths)
                for j in at[both >= SIMILAR * (len(of(i)) + lengths - both)]:
                    if t.group[i] != t.group[j] and aligned(word[i], word[j]):
                        t.join(i, j)
                        left.append(t.fp[i])
                        right.append(t.fp[j])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])


def _dealt(cells: DataFrame, limit: int, payload: DataFrame) -> DataFrame:
    """(val, m): one row for each pair of an asking and an answering tile of a bucket.

    ``cells``: val, fp, root, out, weight; ``payload``: fp, size, sig, data. The
    members are dealt to tiles while their rows are small.
    """
    total = cells.groupBy("val").agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.count(F.when(F.col("out"), 1)).alias("n_out"), F.sum(F.when(F.col("out"), F.col("weight"))).alias("w_out"))
    parts = lambda n, w: F.greatest(F.ceil(F.col(n) / TILE), F.ceil(F.col(w) / limit), F.lit(1)).cast("int")
    total = written(total.where("n > 1 and n_out > 0").select("val", parts("n_out", "w_out").alias("na"), parts("n", "w").alias("nb")), "omh-tiles")
    cells = cells.join(total, "val").withColumns({"ta": F.pmod(F.xxhash64("fp", F.lit(1)), "na").cast("int"), "tb": F.pmod(F.xxhash64("fp"), "nb").cast("int")})
    place = lambda ta, tb, a, b: F.struct(ta.alias("ta"), tb.alias("tb"), a.alias("a"), b.alias("b"))
    answers = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda x: place(x, F.col("tb"), F.col("out") & (x == F.col("ta")), F.lit(True)))
    asks = F.transform(F.filter(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.col("out") & (x != F.col("tb"))), lambda x: place(F.col("ta"), x, F.lit(True), F.lit(False)))
    cells = cells.select("val", "fp", "root", "out", F.explode(F.concat(answers, asks)).alias("at")).join(payload, "fp")
    member = F.struct("fp", "root", "out", "size", "sig", "data", F.col("at.a").alias("a"), F.col("at.b").alias("b"))
    return cells.groupBy("val", F.col("at.ta").alias("ta"), F.col("at.tb").alias("tb")).agg(F.collect_list(member).alias("m")).select("val", "m")


def linked(cells: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): accepted pairs that join what asks (``out``) in ``cells(val, fp, root, out)`` to the other members of its buckets."""
    low = own.select("fp", "size", "sig", F.col("low").alias("data"))
    near = written(_dealt(cells.withColumn("weight", F.lit(1)), TILE, low).mapInArrow(_promising, "val long, fp binary").distinct(), "omh-promising")
    # A table, so that Spark knows its size before it moves texts to it.
    wanted = written(near.select("fp").distinct().join(own, "fp").select("at", "th", "fp", "n_words", "size", "sig"), "omh-wanted")
    word = docs.join(wanted.select("at", "th", "fp"), ["at", "th"]).select("text", "fp").mapInArrow(_word_hashes, "fp binary, data binary")
    word = written(word.dropDuplicates(["fp"]).join(wanted.select("fp", "size", "sig"), "fp"), "omh-words", free=True)
    whole = cells.join(near, ["val", "fp"]).join(wanted.select("fp", (8 * F.col("n_words")).alias("weight")), "fp")
    return written(_dealt(written(whole, "omh-whole"), TILE_BYTES, word).mapInArrow(_links, "a binary, b binary"), "omh-links")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, at, th, text): ``at`` and ``th`` find a row again by its id and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"), F.xxhash64("text").alias("th"), "text")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members(doc_id, fp) of every row, and classes(fp, class_id, kept_fp, kept_th) of every word sequence."""
    docs = keyed(docs)
    members = docs.select("doc_id", "th", "text").mapInArrow(_sketches, "doc_id long, th long, fp binary, size int, n_words int, sig array<long>, low binary")
    members = written(members, "omh-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")).alias("h")
    own = members.where("fp is not null").groupBy("fp").agg(first, *(F.first(c).alias(c) for c in ("size", "n_words", "sig", "low")))
    own = written(own.select("fp", F.col("h.doc_id").alias("doc_id"), F.coalesce("h.doc_id", F.lit(-(1 << 63))).alias("at"), F.col("h.th").alias("th"), "size", "n_words", "sig", "low"), "omh-texts")
    rows = own.select("fp", F.explode("sig").alias("val"))
    # Aggregates are tables of their own before they are joined: hot keys of a join of plain shuffles can be split.
    crowded = written(rows.groupBy("val").agg(F.count("*").alias("c")).where("c > 1"), "omh-crowded")
    shared = written(rows.join(crowded, "val"), "omh-shared")
    links = labels = None
    large = shared.where(F.col("c") > TILE)
    if not large.isEmpty():
        weight = shared.groupBy("fp").agg(F.sum("c").alias("w"))
        hubs = written(large.join(weight, "fp").groupBy("val").agg(F.max(F.struct("w", "fp")).alias("h")).select("val", F.col("h.fp").alias("hub")), "omh-hubs")
        cells = large.join(hubs, "val").select("val", "fp", F.col("fp").alias("root"), (F.col("fp") == F.col("hub")).alias("out"))
        links = linked(written(cells, "omh-cells"), own, docs)
        if not links.isEmpty():
            labels = connected(links)
    placed = shared.select("val", "fp", F.col("fp").alias("root"))
    if labels is not None:
        placed = shared.select("val", "fp").join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").select("val", "fp", F.coalesce("root", "fp").alias("root"))
    # The largest class of a bucket does not ask: its members meet those of the others.
    groups = placed.groupBy("val", "root").agg(F.count("*").alias("n"))
    tops = groups.groupBy("val").agg(F.max(F.struct("n", "root")).alias("t"), F.count("*").alias("roots")).where("roots > 1").select("val", F.col("t.root").alias("top"))
    cells = placed.join(written(tops, "omh-tops"), "val").select("val", "fp", "root", (F.col("root") != F.col("top")).alias("out"))
    more = linked(written(cells, "omh-cells"), own, docs)
    if not more.isEmpty():
        labels = connected(more if links is None else links.union(more))
    # The kept text of a class: that of the smallest doc_id; a text without one comes last.
    node = own.select("fp", "doc_id", "th")
    if labels is not None:
        node = node.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    else:
        node = node.withColumn("root", F.col("fp"))
    node = written(node, "omh-nodes")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("class_id"), F.col("fp").alias("kept_fp"), F.col("th").alias("kept_th")))
    head = written(node.groupBy("root").agg(head.alias("h")), "omh-heads")
    return members.select("doc_id", "fp"), node.join(head, "root").select("fp", "h.class_id", "h.kept_fp", "h.kept_th")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id, kept (whether it stands for its class). A text without words is its own class."""
    members, found = classes(docs)
    rows = members.join(found, "fp", "left")
    kept = F.when(F.col("fp").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("fp") == F.col("kept_fp")))
    return rows.select("doc_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; texts without words stay. Of repeated rows one stays."""
    _, found = classes(docs)
    chosen = found.where(F.col("fp") == F.col("kept_fp")).select(F.coalesce("class_id", F.lit(-(1 << 63))).alias("_omh_at"), F.col("kept_th").alias("_omh_th"))
    rows = docs.withColumns({"_omh_at": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_omh_th": F.xxhash64(text_of("text"))})
    worded = text_of("text").rlike(WORD)
    kept = rows.where(worded).join(chosen, ["_omh_at", "_omh_th"]).dropDuplicates(["_omh_at", "_omh_th"])
    return kept.select(*docs.columns).unionByName(rows.where(~worded).select(*docs.columns))

"""Phrase collocations: a minimal perfect hash over Apriori-safe candidates, counted by slot.

A phrase of up to four words can be frequent only if all phrases inside it
are. Upper bounds come first: every window is hashed into one of many buckets,
tasks bincount theirs, the arrays are summed by segments of the bucket space,
and a bucket below the least count rules out all its windows. Words go first,
then windows of two to four words whose words have all passed. A window is a
candidate if its bucket and those of all windows inside it pass; no frequent
phrase can be lost, whatever collides.

The distinct candidates (128-bit keys of language and words, with the least
task that has them; a task sends its own packed by ranges) get a minimal perfect
hash of cascaded bit arrays, made range by range in the tasks that make them
distinct. Every window that passes the filter is a candidate, so the hash is
never asked for another key and keys need not be stored: some 6 bits and the
number of a task are left of each. Ranges are dealt to waves of at most ``WAVE``
keys. With one wave broadcast, each task counts the slots of its windows in one
array, and writes out the words of the candidates that it has as the first
task; arrays are summed in a tree. Counts of phrases, of both sides of each cut
and of longer phrases around a phrase are then read by slot.

What is broadcast is bounded: ``BUCKETS`` bits, and a hash of ``WAVE`` keys. The
bits are as many as half the words of the corpus, up to that bound; beyond it
the filter lets more windows pass, and with more candidates than a wave holds
the corpus is read once a wave. Results are exact at any size. For corpora far beyond,
``least`` should grow with the corpus, which keeps the candidates few.

Null text is empty, null language is ``und``. Texts of any length are read
whole; repeated rows count as often as they occur;
empty tables give no rows; further columns are not read. Two phrases share a
key with probability 2^-110 a pair at most.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, partitions, text_of, window_hashes, written

LONGEST = 4
LEAST, COVERED_PERCENT, SCALE, TOP = 30, 80, 2_000_000, 2000
#: Most buckets (a bit each is broadcast: 64 MB), buckets of a segment, keys of a wave (some 3 bytes each are broadcast, 5 more are in a worker), slots of an array that travels, windows a task gathers at a time.
BUCKETS, SEGMENT, WAVE, BLOCK, GATHERED = 1 << 29, 1 << 20, 1 << 24, 4096, 1 << 19
#: Ranges of the first half of a key (2^10) in which candidates travel: a task sends at most one row for each.
RANGE_BITS = 10
GROUP = 1 << 18  # bytes of text whose windows are made together
#: Tasks whose arrays are summed at the first level of the tree.
FAN = 64
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))  # any two numbers
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: in each round the keys that are alone at their place are done.

    A key's slot is the number of set bits before its own over all rounds.
    """

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        rounds, left, self.sizes = [], np.arange(len(first)), []
        while len(left):
            size = 2 * len(left) + 1
            at = self._place(first[left], second[left], len(rounds), size)
            alone = np.bincount(at, minlength=size) == 1
            rounds.append(alone)
            self.sizes.append(size)
            left = left[~alone[at]]
        self.bits = np.packbits(np.concatenate(rounds)) if rounds else np.empty(0, np.uint8)
        self._rank()
        self.n = len(first)
        slots = self._slots(first, second)
        self.first, self.second = np.empty_like(first), np.empty_like(second)
        self.first[slots], self.second[slots] = first, second

    @staticmethod
    def _place(first, second, k: int, size: int | np.ndarray) -> np.ndarray:
        return (mixed(first ^ (second * np.uint64(2 * k + 1)) ^ np.uint64(k)) % np.asarray(size, np.uint64)).astype(np.int64)

    def _rank(self) -> None:
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    def _slots(self, first, second) -> np.ndarray:
        """The slot of each key; of keys that are not in the set some slot or -1."""
        out = np.full(len(first), -1, np.int64)
        left, start = np.arange(len(first)), 0
        for k, size in enumerate(self.sizes):
            if not len(left):
                break
            at = start + self._place(first[left], second[left], k, size)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> (7 - bit)) & 1 == 1
            done, byte, bit = left[hit], byte[hit], bit[hit]
            high = self.bits[byte] & (~np.uint16(0xFF >> bit) & np.uint16(0xFF)).astype(np.uint8)
            out[done] = self.before[byte] + np.bitwise_count(high)
            left, start = left[~hit], start + size
        return out

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slots; -1 where the key stored there is another."""
        at = self._slots(first, second)
        if self.n:
            same = (at >= 0) & (self.first[at] == first) & (self.second[at] == second)
            at[~same] = -1
        return at


class Slots:
    """The perfect hashes of a run of ranges of keys as one, for keys that are in them; keys of other ranges have no slot.

    ``ranges``: (at, sizes, bits) of each by ``at``; ``parts``: the least task of each slot.
    """

    def __init__(self, ranges: list[tuple[int, np.ndarray, np.ndarray]], parts: np.ndarray) -> None:
        self.low, last = (ranges[0][0], ranges[-1][0]) if ranges else (0, -1)
        rounds = max((len(sizes) for _, sizes, _ in ranges), default=0)
        self.sizes, self.starts = np.ones((rounds, last + 1 - self.low), np.uint64), np.zeros((rounds, last + 1 - self.low), np.int64)
        behind = 0
        for at, sizes, bits in ranges:
            self.sizes[: len(sizes), at - self.low] = sizes
            self.starts[: len(sizes), at - self.low] = behind + np.cumsum(sizes) - sizes
            behind += 8 * len(bits)
        held = np.concatenate([*(bits for _, _, bits in ranges), np.zeros(-(behind >> 3) % 8, np.uint8)])
        self.bits = held.view(">u8").astype(np.uint64)
        ones = np.bitwise_count(self.bits).astype(np.uint32)
        self.before = np.cumsum(ones, dtype=np.uint32) - ones
        self.parts, self.n = parts, len(parts)

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.full(len(first), -1, np.int64)
        own = (first >> np.uint64(64 - RANGE_BITS)).astype(np.int64) - self.low
        left = np.flatnonzero((own >= 0) & (own < self.sizes.shape[1]))
        for k in range(len(self.sizes)):
            if not len(left):
                break
            at = self.starts[k][own[left]] + PerfectHash._place(first[left], second[left], k, self.sizes[k][own[left]])
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> (np.uint64(63) - bit)) & np.uint64(1) == 1
            high = word[hit] & ~(np.uint64((1 << 64) - 1) >> bit[hit])
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(high)
            left = left[~hit]
        return out


class Words(NamedTuple):
    """Words of a buffer by their places."""

    buf: bytes
    starts: np.ndarray
    ends: np.ndarray

    def text(self, k: int, m: int) -> str:
        return b" ".join([self.buf[i:j] for i, j in zip(self.starts[k : k + m].tolist(), self.ends[k : k + m].tolist(), strict=True)]).decode("utf-8", "surrogatepass")


class Windows:
    """Word windows of many texts at a time, with their keys. A mark stands between pieces; no window may hold one."""

    def __init__(self) -> None:
        self.langs: dict[tuple[str, int], tuple[np.uint64, np.uint64]] = {}
        self.weights = tuple(np.empty(0, np.uint64) for _ in SEEDS)

    def groups(self, batches, text: str = "text"):
        """(lang, Words, hashes, which are words and not marks, rows of the texts) in groups of one language and some ``GROUP`` bytes.

        Rows are counted over all batches; ``row[i]`` is the row of word ``i``.
        """
        held: dict[str, tuple[list[bytes], list[int], list[int]]] = {}
        n = 0
        for b in (whole.slice(i, 128) for whole in batches for i in range(0, whole.num_rows, 128)):  # few texts are Python objects at a time
            for lang, t in zip(b.column("lang").to_pylist(), b.column(text).to_pylist(), strict=True):
                parts, rows, size = held.setdefault(lang, ([], [], [0]))
                parts.append(t.encode("utf-8", "surrogatepass").translate(_LOWER))
                rows.append(n)
                size[0] += len(parts[-1])
                n += 1
                if size[0] >= GROUP:
                    yield self._group(lang, *held.pop(lang)[:2])
        for lang, (parts, rows, _) in held.items():
            yield self._group(lang, parts, rows)

    def _group(self, lang: str, parts: list[bytes], rows: list[int]):
        buf = b"\n".join([*parts, b""])
        made, at = [], 0
        while at < len(buf):  # cut behind a blank or mark, so that a word is in one block
            end = min(len(buf), at + GROUP)
            if end < len(buf):
                cut = max(buf.rfind(b" ", at, end), buf.rfind(b"\n", at, end)) + 1
                if cut <= at:
                    cut = min(x for x in (buf.find(b" ", end), buf.find(b"\n", end)) if x >= 0) + 1
                end = cut
            made.append(self._words(buf, at, end))
            at = end
        starts, ends, first, second = (np.concatenate(x) for x in zip(*made, strict=True))
        behind = np.cumsum([len(p) + 1 for p in parts])
        return lang, Words(buf, starts, ends), (first, second), ends > 0, np.array(rows)[np.searchsorted(behind, starts, side="right")]

    def _words(self, buf: bytes, at: int, end: int):
        """(starts, ends or -1 for a mark, two hashes) of the words and marks of a block.

        A word's hash is the sum of its bytes by the random weights of their
        places in it: two words meet in both with probability 2^-114 at most.
        """
        data = np.frombuffer(buf, np.uint8, end - at, at)
        mark, word = data == 10, (data != 10) & (data != 32)
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        marks = mark.copy()
        marks[1:] &= ~mark[:-1]
        starts = np.flatnonzero(begins | marks)
        if not len(starts):
            none = np.empty(0, np.uint64)
            return starts, starts, none, none
        stops = word.copy()
        stops[:-1] &= ~word[1:]
        is_word = word[starts]
        ends = np.full(len(starts), -1, np.int64)
        ends[is_word] = at + np.flatnonzero(stops) + 1
        place = np.arange(len(data))
        place[starts[0] :] -= np.repeat(starts, np.diff(np.r_[starts, len(data)]))
        place[~word] = 0
        longest = int(place.max()) + 1
        if longest > len(self.weights[0]):
            self.weights = tuple(mixed(np.arange(longest, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed) for seed in SEEDS)
        value = np.where(word, data, 0).astype(np.uint64)
        value[word] += np.uint64(1)
        return at + starts, ends, *(np.add.reduceat(value * w[place], starts) for w in self.weights)

    def salt(self, lang: str, m: int) -> tuple[np.uint64, np.uint64]:
        found = self.langs.get((lang, m))
        if found is None:
            both = xxhash.xxh3_128_intdigest(f"{m}:{lang}".encode("utf-8", "surrogatepass"))
            found = self.langs[lang, m] = (np.uint64(both & 0xFFFFFFFFFFFFFFFF), np.uint64(both >> 64))
        return found

    def keys(self, lang: str, both, m: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """128-bit keys of the runs of ``m`` words (those that start ``at`` some places)."""
        out = []
        for h, salt in zip(both, self.salt(lang, m), strict=True):
            h = window_hashes(h, m)
            out.append(mixed((h if at is None else h[at]) ^ salt))
        return out[0], out[1]


class Filter:
    """Which windows may be frequent: the bits of the buckets, for one word and for more words."""

    def __init__(self, bits: list[np.ndarray]) -> None:
        self.bits = bits

    def passes(self, kind: int, first: np.ndarray) -> np.ndarray:
        bits = self.bits[kind]
        at = first & np.uint64(8 * len(bits) - 1)
        return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def windows(self, w: Windows, lang: str, both, is_word: np.ndarray):
        """(m, starts, keys) of the windows whose words pass; with both kinds of bits, of those that may be frequent."""
        one = w.keys(lang, both, 1)
        inner = is_word & self.passes(0, one[0])
        yield 1, np.flatnonzero(inner), (one[0][inner], one[1][inner])
        for m in range(2, LONGEST + 1):
            # Windows inside are those from the same start and from the next one.
            at = np.flatnonzero(inner[:-1] & inner[1:])
            if not len(at):
                return
            a, b = w.keys(lang, both, m, at)
            inner = inner[:-1] & inner[1:]
            if len(self.bits) > 1:
                good = self.passes(1, a)
                at, a, b = at[good], a[good], b[good]
                inner = np.zeros(len(inner), bool)
                inner[at] = True
            yield m, at, (a, b)


def _size(words: int, most: int, least: int = 1 << 16) -> int:
    return min(most, max(least, 1 << max(0, int(words)).bit_length()))


def _packed(values: np.ndarray) -> bytes:
    """Values as bytes, the lowest of all of them first: small values leave runs of zeros, which the codec of the shuffle folds."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _steps(values: np.ndarray) -> bytes:
    """Ascending values, packed as their differences."""
    return _packed(np.r_[values[:1], np.diff(values)])


def _summed(rows: DataFrame, size: int, *by: str, finish=None, ddl: str = "") -> DataFrame:
    """(by, at, pos, counts) with the arrays of equal (by, at) added up; at most one array is in memory.

    ``pos`` are packed steps and ``counts`` packed values of 32 bits; where ``pos`` is empty, ``counts`` is the whole array, packed, of 64-bit values.
    ``finish(at, array)`` gives batches of ``ddl`` in place of a sum, in the same task and worker.
    """
    names = [*by, "at"]

    def packed(key, total):
        yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([b""], pa.binary()), pa.array([_packed(total)], pa.binary())], names=[*names, "pos", "counts"])

    def out(key, total):
        return packed(key, total) if finish is None else finish(key[-1], total)

    def run(batches):
        held, total = None, None
        for b in batches:
            for *key, pos, counts in zip(*(b.column(c).to_pylist() for c in (*names, "pos", "counts")), strict=True):
                if key != held:
                    if held is not None:
                        yield from out(held, total)
                    held, total = key, np.zeros(size, np.int64)
                if pos:
                    total[np.cumsum(_unpacked(pos, np.uint32), dtype=np.int64)] += _unpacked(counts, np.uint32)  # the places of one row differ
                else:
                    counts = _unpacked(counts, np.int64)
                    total[: len(counts)] += counts
        if held is not None:
            yield from out(held, total)

    sorted_ = rows.repartition(partitions(rows.sparkSession), *names).sortWithinPartitions(*names)
    return sorted_.select(*names, "pos", "counts").mapInArrow(run, ddl or ", ".join(f"{c} long" for c in names) + ", pos binary, counts binary")


def _bucket_bits(docs: DataFrame, bits: list, buckets: int, least: int) -> np.ndarray:
    """The buckets of windows that reach ``least``: words, if ``bits`` is empty, else windows of two words or more."""
    sc = docs.sparkSession.sparkContext
    given = sc.broadcast(bits)
    size = min(SEGMENT, buckets)

    def run(batches):
        w, f = Windows(), Filter(given.value)
        held, n = [], 0

        def out():
            at, counts = np.unique(np.concatenate(held), return_counts=True)
            segment = at // size
            cuts = np.flatnonzero(np.diff(segment, prepend=-1))
            ends = [*cuts[1:], len(at)]
            return pa.RecordBatch.from_arrays([
                pa.array(segment[cuts], pa.int64()), pa.array([_steps((at[i:j] % size).astype(np.uint32)) for i, j in zip(cuts, ends, strict=True)], pa.binary()),
                pa.array([_packed(counts[i:j].astype(np.uint32)) for i, j in zip(cuts, ends, strict=True)], pa.binary()),
            ], names=["at", "pos", "counts"])

        for lang, _, both, is_word, _ in w.groups(batches):
            if not f.bits:
                made = [w.keys(lang, both, 1)[0][is_word]]
            else:
                made = [keys[0] for m, _, keys in f.windows(w, lang, both, is_word) if m > 1]
            for first in made:
                held.append((first & np.uint64(buckets - 1)).astype(np.int64))
                n += len(first)
            if n >= GATHERED:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def flags(at, total):
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["at", "bits"])

    summed = _summed(docs.mapInArrow(run, "at long, pos binary, counts binary"), size, finish=flags, ddl="at long, bits binary")
    out = np.zeros(buckets // 8, np.uint8)
    for r in summed.toLocalIterator():
        out[r.at * size // 8 : (r.at + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _distinct(held: list[tuple]) -> tuple:
    """The distinct keys (first, second, part) of arrays, in order; of equal ones the least part stays."""
    a, b, part = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((part, b, a))
    a, b, part = a[order], b[order], part[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], part[new]


def _candidates(docs: DataFrame, bits) -> DataFrame:
    """(at, n, sizes, bits, parts): of each range of the distinct candidates their number, their perfect hash, and by slot the least task that has them.

    A task sends its distinct keys packed, by ranges of their first half; a
    range is made distinct piece by piece, so that only its keys are in memory.
    """
    shift = np.uint64(64 - RANGE_BITS)

    def run(batches):
        w, f = Windows(), Filter(bits.value)
        part = TaskContext.get().partitionId()
        held, n, known = [], 0, 0
        for lang, _, both, is_word, _ in w.groups(batches):
            for _, _, keys in f.windows(w, lang, both, is_word):
                held.append((*keys, np.full(len(keys[0]), part, np.int32)))
                n += len(keys[0])
            if n >= known + max(GATHERED, known):
                held = [_distinct(held)]
                n = known = len(held[0][0])
        if n:
            a, b, _ = _distinct(held)
            ranges = (a >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
            for k in range(0, len(cuts), 64):
                some = list(zip(cuts[k : k + 64], np.r_[cuts, len(a)][k + 1 : k + 65], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ranges[cuts[k : k + 64]]), pa.array([part] * len(some), pa.int32()),
                    pa.array([_steps(a[i:j]) for i, j in some], pa.binary()), pa.array([b[i:j].tobytes() for i, j in some], pa.binary()),
                ], names=["at", "part", "first", "second"])

    def merged(batches):
        def out():
            a, b, part = _distinct(held)
            h = PerfectHash(a, b)
            parts = np.empty(h.n, np.int32)
            parts[h.find(a, b)] = part
            yield pa.RecordBatch.from_arrays([
                pa.array([now], pa.int64()), pa.array([h.n], pa.int64()), pa.array([np.array(h.sizes, np.int64).tobytes()], pa.binary()),
                pa.array([h.bits.tobytes()], pa.binary()), pa.array([parts.tobytes()], pa.binary()),
            ], names=["at", "n", "sizes", "bits", "parts"])

        now, held, n, known = None, [], 0, 0
        for batch in batches:
            for at, part, first, second in zip(*(batch.column(c).to_pylist() for c in ("at", "part", "first", "second")), strict=True):
                if at != now:
                    if held:
                        yield from out()
                    now, held, n, known = at, [], 0, 0
                first = np.cumsum(_unpacked(first, np.uint64), dtype=np.uint64)
                held.append((first, np.frombuffer(second, np.uint64), np.full(len(first), part, np.int32)))
                n += len(first)
                if n >= known + max(GATHERED, known):
                    held = [_distinct(held)]
                    n = known = len(held[0][0])
        if held:
            yield from out()

    sent = docs.mapInArrow(run, "at long, part int, first binary, second binary")
    dealt = sent.repartition(partitions(docs.sparkSession), "at").sortWithinPartitions("at")
    return dealt.mapInArrow(merged, "at long, n long, sizes binary, bits binary, parts binary")


def _waves(found: DataFrame, most: int) -> list[tuple[int, int]]:
    """Runs of ranges (first, last) of at most ``most`` candidates, but whole ranges."""
    out, held = [], 0
    for at, n in sorted((r.at, r.n) for r in found.select("at", "n").collect()):  # at most 2^RANGE_BITS rows
        if not out or held + n > most:
            out.append((at, at))
            held = 0
        out[-1] = out[-1][0], at
        held += n
    return out or [(0, -1)]


def _slots(found: DataFrame, low: int, high: int) -> Slots:
    rows = found.where(F.col("at").between(low, high)).orderBy("at").toArrow()
    at, sizes, bits, parts = (rows.column(c).to_pylist() for c in ("at", "sizes", "bits", "parts"))
    parts = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(p, np.int32) for p in parts)])
    parts = parts.astype(np.min_scalar_type(int(parts.max(initial=0))))
    return Slots([(k, np.frombuffer(s, np.int64), np.frombuffer(b, np.uint8)) for k, s, b in zip(at, sizes, bits, strict=True)], parts)


def _counted(docs: DataFrame, bits, hashed) -> DataFrame:
    """Arrays (part, at, pos, counts) of the slots that a task has filled, and (slot, lang, m, phrase) of those that it has as the first task; a table."""

    def run(batches):
        w, f = Windows(), Filter(bits.value)
        h = hashed.value
        part = TaskContext.get().partitionId()
        total, mine = np.zeros(h.n, np.uint32), h.parts == part
        for lang, words, both, is_word, _ in w.groups(batches):
            told: list[tuple] = []
            for m, at, keys in f.windows(w, lang, both, is_word):
                slots = h.of(*keys)
                at, slots = at[slots >= 0], slots[slots >= 0]
                np.add.at(total, slots, np.uint32(1))  # costs by windows; a bincount would cost by slots
                own = mine[slots]
                first, i = np.unique(slots[own], return_index=True)
                mine[first] = False
                told += [(slot, lang, m, words.text(k, m)) for slot, k in zip(first.tolist(), at[own][i].tolist(), strict=True)]
            if told:
                slot, langs, ms, phrases = zip(*told, strict=True)
                none = pa.nulls(len(slot), pa.int64()), pa.nulls(len(slot), pa.int64()), pa.nulls(len(slot), pa.binary()), pa.nulls(len(slot), pa.binary())
                yield pa.RecordBatch.from_arrays([*none, pa.array(slot, pa.int64()), pa.array(langs, pa.string()), pa.array(ms, pa.int32()), pa.array(phrases, pa.string())], names=names)
        for i in range(0, h.n, 64 * BLOCK):
            ks = [k for k in range(i, min(h.n, i + 64 * BLOCK), BLOCK) if total[k : k + BLOCK].any()]
            used = [np.flatnonzero(total[k : k + BLOCK]) for k in ks]
            none = pa.nulls(len(ks), pa.int64()), pa.nulls(len(ks), pa.string()), pa.nulls(len(ks), pa.int32()), pa.nulls(len(ks), pa.string())
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * len(ks), pa.int64()), pa.array([k // BLOCK for k in ks], pa.int64()), pa.array([_steps(u.astype(np.uint32)) for u in used], pa.binary()),
                pa.array([_packed(total[k + u]) for k, u in zip(ks, used, strict=True)], pa.binary()), *none,
            ], names=names)

    names = ["part", "at", "pos", "counts", "slot", "lang", "m", "phrase"]
    return written(docs.mapInArrow(run, "part long, at long, pos binary, counts binary, slot long, lang string, m int, phrase string"), "phrase-arrays")


def _sums(rows: DataFrame) -> DataFrame:
    """(slot, f): the arrays summed in a tree, those of FAN tasks first, then the sums."""
    arrays = rows.where("at is not null").select((F.expr(f"part DIV {FAN}")).alias("part"), "at", "pos", "counts")

    def slots(k, total):
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k * BLOCK + at), pa.array(total[at])], names=["slot", "f"])

    return _summed(_summed(arrays, BLOCK, "part"), BLOCK, finish=slots, ddl="slot long, f long")


def _insides(phrases: DataFrame, hashed) -> DataFrame:
    """(id, i, size, slot) of the phrases inside each of ``phrases(id, lang, m, phrase)``: ``size`` words from its word ``i``."""

    def run(batches):
        w, h = Windows(), hashed.value
        for b in batches:
            ids, ms = (b.column(c).to_numpy() for c in ("id", "m"))
            for lang, _, both, is_word, row in w.groups([b], "phrase"):
                start = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
                place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
                for size in range(1, LONGEST):
                    n = len(row) - size + 1
                    at = np.flatnonzero(is_word[:n] & (place[:n] + size <= ms[row[:n]]) & (ms[row[:n]] > size)) if n > 0 else []
                    if len(at):
                        slot = h.of(*w.keys(lang, both, size, at))
                        at, slot = at[slot >= 0], slot[slot >= 0]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[row[at]]), pa.array(place[at]), pa.array(np.full(len(at), size)), pa.array(slot)], names=["id", "i", "size", "slot"])

    return phrases.select("id", "lang", "m", "phrase").mapInArrow(run, "id long, i long, size long, slot long")


def collocations(docs: DataFrame, *, least: int = LEAST, covered_percent: int = COVERED_PERCENT, wave: int = WAVE, most_buckets: int = BUCKETS) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two to four words that stay.

    A phrase occurs ``a`` times, at least ``least``; its lowest-scoring cut has
    parts that occur ``l`` and ``r`` times; ``n`` is the number of words of the
    language. Phrases inside a longer frequent one with ``covered_percent`` of
    their count are left out.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of("text").alias("text"))
    size = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    words = _bucket_bits(docs, [], _size(size // 4, most_buckets), least)
    more = _bucket_bits(docs, [words], _size(size // 2, most_buckets), least)
    bits = sc.broadcast([words, more])
    found = written(_candidates(docs, bits), "phrase-candidates")
    runs = _waves(found, wave)
    waves = len(runs)

    counted, hashes = None, []
    for k, (low, high) in enumerate(runs):
        hashed = sc.broadcast(_slots(found, low, high))
        hashes.append(hashed)
        rows = _counted(docs, bits, hashed)
        part = _sums(rows).where(F.col("f") >= least).join(rows.where("slot is not null").select("slot", "lang", "m", "phrase"), "slot", "left")
        part = part.select((F.lit(k) + F.col("slot") * waves).alias("id"), "lang", "m", "phrase", "f")
        counted = part if counted is None else counted.unionByName(part)
    frequent = written(counted, "phrase-counts")
    if not frequent.where("phrase is null").isEmpty():
        raise RuntimeError("the tasks of docs are dealt anew each time it is read: write it as a table first")

    insides = None
    for k, hashed in enumerate(hashes):
        part = _insides(frequent.where("m > 1"), hashed).withColumn("inside", F.lit(k) + F.col("slot") * waves).drop("slot")
        insides = part if insides is None else insides.unionByName(part)
    counts = frequent.select(F.col("id").alias("inside"), F.col("f").alias("g"))
    insides = written(insides.join(counts, "inside"), "phrase-insides")

    wide = lambda c: F.col(c).cast("decimal(38,0)")
    longer = frequent.select("id", F.col("f").alias("a"))
    covers = insides.where("size > 1").join(longer, "id").groupBy(F.col("inside").alias("id")).agg(F.max("a").alias("around"))
    left = insides.where("i = 0").select("id", F.col("size").alias("k"), F.col("g").alias("l"))
    right = insides.join(longer.join(frequent.select("id", "m"), "id"), "id").where("i + size = m AND i > 0").select("id", F.col("i").alias("k"), F.col("g").alias("r"))
    cuts = left.join(right, ["id", "k"]).join(longer, "id").withColumn("score", F.expr(f"CAST(a AS DECIMAL(30,0)) * {SCALE}BD DIV (CAST(l AS DECIMAL(30,0)) + CAST(r AS DECIMAL(30,0)))"))  # at most a million
    lowest = cuts.groupBy("id").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    n = docs.groupBy("lang").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+"), F.lit(0)))).alias("n"))
    kept = frequent.where("m > 1").join(covers, "id", "left").where(F.col("around").isNull() | (wide("around") * 100 < wide("f") * covered_percent))
    return kept.join(lowest, "id").join(n, "lang").select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def top_phrases(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language by score, count and phrase, ranked from 1; a task sends at most ``top`` a language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))

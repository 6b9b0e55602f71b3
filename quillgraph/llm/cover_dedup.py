"""Substring dedup: repeated windows of words, found through difference-cover anchors.

Two equal windows of ``WINDOW`` words may start at any positions p and q.
``COVER`` is a difference cover modulo ``PERIOD``: for every p, q some shift
below PERIOD brings both onto cover positions. So if runs of ``ANCHOR`` =
WINDOW - PERIOD + 1 words are hashed at cover positions only (5 of 21), equal
windows share an equal anchor at the same shift. Only windows around repeated
anchors are then hashed whole (128 bits) and compared over all documents. A
word goes if a repeated window covers it.

Hashes travel packed: a task sends one row of arrays to each part, not a row a
hash. What repeats inside a task is settled there and leaves as one hash, so a
passage that a third of all documents share adds one entry a task. Parts are as
many as the bytes of the input ask for.

Null text has no words. Repeated rows are separate occurrences: all their
windows repeat. Texts under WINDOW words stay whole. Further columns are not
read by ``repeated_words``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, partitions, row_key, text_of, window_hashes, written

WINDOW, PERIOD = 35, 21
#: A perfect difference set modulo 21.
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
FLUSH = 2_000_000  # hashes a task gathers before it sends them
PART_BYTES = 256 << 20  # of input text for each part, about 200 MB of packed hashes at most
PACKED = "part int, found boolean, keys binary, doc binary, pos binary, h1 binary, h2 binary"
FOUND = "part int, keys binary, doc binary, pos binary"
POSITIONS = "key binary, pos binary"


def anchors(n: int) -> np.ndarray:
    """Cover positions of a text of n words at which an anchor fits."""
    at = np.arange(max(0, n - ANCHOR + 1))
    return at[np.isin(at % PERIOD, COVER)]


def window_starts(found: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of a text of n words that hold one of the anchors ``found``."""
    edge = np.zeros(n + 2, dtype=np.int64)
    np.add.at(edge, np.maximum(found - (WINDOW - ANCHOR), 0), 1)
    np.add.at(edge, np.minimum(found, n - WINDOW) + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: n - WINDOW + 1] > 0)


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words under windows that start at ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge)[:n] > 0


def _same_as_next(h1: np.ndarray, h2: np.ndarray | None) -> np.ndarray:
    same = h1[1:] == h1[:-1]
    return same if h2 is None else same & (h2[1:] == h2[:-1])


def _sorted(h1: np.ndarray, h2: np.ndarray | None) -> np.ndarray:
    return np.argsort(h1, kind="stable") if h2 is None else np.lexsort((h2, h1))


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as their low and then their high halves: the high ones are mostly zero and compress away."""
    x = x.astype(np.uint32)
    return (x & np.uint32(0xFFFF)).astype("<u2").tobytes() + (x >> np.uint32(16)).astype("<u2").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    half = np.frombuffer(raw, "<u2").astype(np.uint32)
    n = len(half) // 2
    return half[:n] | half[n:] << np.uint32(16)


def _owners(raw: bytes) -> np.ndarray:
    """The document of each entry, from the entries' counts."""
    counts = _numbers(raw)
    return np.repeat(np.arange(len(counts)), counts)


def _packed(parts: int, keys: list[bytes], doc: np.ndarray, pos: np.ndarray):
    """(part, keys, counts, pos): the entries of some documents, one row for each part that their keys belong to."""
    if not len(doc):
        return
    docs, doc = np.unique(doc, return_inverse=True)
    part = np.array([int.from_bytes(keys[d][:4], "little") % parts for d in docs], dtype=np.int64)
    order = np.lexsort((pos, doc, part[doc]))
    doc, pos = doc[order], pos[order]
    cut = np.flatnonzero(np.r_[True, part[doc][1:] != part[doc][:-1]])
    for s, e in zip(cut, np.r_[cut[1:], len(doc)], strict=True):
        here, counts = np.unique(doc[s:e], return_counts=True)
        yield int(part[here[0]]), b"".join(keys[docs[d]] for d in here), _planes(counts), _planes(pos[s:e])


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "doc", "pos"])


def _gather(batches):
    """The positions of each document, of the packed rows of whole parts."""
    keys, doc, pos, n = [], [], [], 0
    for b in batches:
        for k, d, p in zip(*(b.column(x).to_pylist() for x in ("keys", "doc", "pos")), strict=True):
            keys.append(k)
            doc.append(_owners(d) + n)
            pos.append(_numbers(p))
            n += len(k) // 16
    if not n:
        return
    names, at = np.unique(np.frombuffer(b"".join(keys), dtype="V16"), return_inverse=True)
    doc, pos = at[np.concatenate(doc)], np.concatenate(pos)
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    rows = [(names[doc[s]].tobytes(), pos[s:e].tobytes()) for s, e in zip(cut, np.r_[cut[1:], len(doc)], strict=True)]
    for k in range(0, len(rows), 5_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows[k : k + 5_000], strict=True)], names=["key", "pos"])


class Packer:
    """Gathers (document, position, hash) and sends packed rows to the parts."""

    def __init__(self, parts: int, wide: bool) -> None:
        self.parts, self.wide = parts, wide
        self.clear()

    def clear(self) -> None:
        self.keys: list[bytes] = []
        self.doc, self.pos, self.h1, self.h2, self.n = [], [], [], [], 0

    def add(self, key: bytes, pos: np.ndarray, h1: np.ndarray, h2: np.ndarray | None = None) -> None:
        self.doc.append(np.full(len(pos), len(self.keys), dtype=np.uint32))
        self.keys.append(key)
        self.pos.append(pos.astype(np.uint32))
        self.h1.append(h1)
        if self.wide:
            self.h2.append(h2)
        self.n += len(pos)

    def send(self):
        if not self.n:
            return
        doc, pos, h1 = map(np.concatenate, (self.doc, self.pos, self.h1))
        h2 = np.concatenate(self.h2) if self.wide else None
        order = _sorted(h1, h2)
        same = _same_as_next(h1[order], h2[order] if self.wide else None)
        again, more = np.r_[False, same], np.r_[same, False]
        repeats = np.zeros(self.n, dtype=bool)
        repeats[order] = again | more
        sent = np.ones(self.n, dtype=bool)
        sent[order] = ~again
        rows: list[tuple] = []
        at = np.flatnonzero(repeats)
        rows += [(part, True, k, d, p, b"", b"") for part, k, d, p in _packed(self.parts, self.keys, doc[at], pos[at])]
        at = np.flatnonzero(sent)
        part = (h1[at] % np.uint64(self.parts)).astype(np.int64)
        at = at[np.argsort(part, kind="stable")]
        part.sort()
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for s, e in zip(cut, np.r_[cut[1:], len(part)], strict=True):
            here = at[s:e]
            docs, counts = np.unique(doc[here], return_counts=True)
            rows.append((
                int(part[s]), False, b"".join(self.keys[d] for d in docs), _planes(counts),
                _planes(pos[here] << np.uint32(1) | repeats[here].astype(np.uint32)),
                h1[here].tobytes(), h2[here].tobytes() if self.wide else b"",
            ))
        self.clear()
        for k in range(0, len(rows), 20_000):
            cols = list(zip(*rows[k : k + 20_000], strict=True))
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "found", "keys", "doc", "pos", "h1", "h2"])


def _settle(parts: int):
    """Of the packed rows of whole parts: which entries share their hash with another, packed by document."""

    def run(batches):
        keys, doc, pos, h1, h2 = [], [], [], [], []
        for b in batches:
            done = []
            for part, found, k, d, p, a, c in zip(*(b.column(x).to_pylist() for x in ("part", "found", "keys", "doc", "pos", "h1", "h2")), strict=True):
                if found:
                    done.append((part, k, d, p))
                    continue
                doc.append(_owners(d) + len(keys))
                keys += [k[i : i + 16] for i in range(0, len(k), 16)]
                pos.append(_numbers(p))
                h1.append(np.frombuffer(a, "<u8"))
                if c:
                    h2.append(np.frombuffer(c, "<u8"))
            if done:
                yield _found_batch(done)
        if not h1:
            return
        doc, pos, h1 = map(np.concatenate, (doc, pos, h1))
        h2 = np.concatenate(h2) if h2 else None
        order = _sorted(h1, h2)
        same = _same_as_next(h1[order], h2[order] if h2 is not None else None)
        hit = order[np.r_[False, same] | np.r_[same, False]]
        hit = hit[pos[hit] & 1 == 0]  # those marked have been reported by the task that sent them
        rows = list(_packed(parts, keys, doc[hit], pos[hit] >> 1))
        for k in range(0, len(rows), 5_000):
            yield _found_batch(rows[k : k + 5_000])

    return run


def _repeated(rows: DataFrame, pack, parts: int) -> DataFrame:
    """(key, pos): positions whose hash occurs elsewhere too, one row for each document that has any."""
    sent = rows.mapInArrow(pack(parts), PACKED).repartitionById(parts, "part")  # one part a task, so PART_BYTES holds
    return sent.mapInArrow(_settle(parts), FOUND).repartitionById(parts, "part").mapInArrow(_gather, POSITIONS)


def _anchored(parts: int):
    def run(batches):
        hashes, packer = WordHashes(), Packer(parts, False)
        for b in batches:
            for key, t in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                tokens = t.split()
                if len(tokens) < WINDOW:
                    continue
                at = anchors(len(tokens))
                packer.add(key, at, window_hashes(hashes.of(tokens), ANCHOR)[at])
                if packer.n >= FLUSH:
                    yield from packer.send()
        yield from packer.send()

    return run


def _windowed(parts: int):
    def run(batches):
        hashes, packer = WordHashes(), Packer(parts, True)
        for b in batches:
            for key, t, found in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("pos").to_pylist(), strict=True):
                tokens = t.split()
                at = window_starts(np.frombuffer(found, "<u4").astype(np.int64), len(tokens))
                one, two = hashes.of(tokens, wide=True)
                packer.add(key, at, window_hashes(one, WINDOW)[at], window_hashes(two, WINDOW)[at])
                if packer.n >= FLUSH:
                    yield from packer.send()
        yield from packer.send()

    return run


def _whole(batches):
    """Documents without a repeated anchor are done; the others keep their text."""
    for b in batches:
        n, sha, text = [], [], []
        for t, found in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("pos").to_pylist(), strict=True):
            tokens = t.split()
            n.append(len(tokens))
            sha.append(None if found else hashlib.sha256(b" ".join(tokens)).hexdigest())
            text.append(t if found else None)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("key"), b.column("pos"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary()).cast(pa.string())],
            names=["doc_id", "key", "pos", "n_words", "kept_sha256", "text"],
        )


def _cut(batches):
    for b in batches:
        gone, sha, kept = [], [], []
        for t, found in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("starts").to_pylist(), strict=True):
            tokens = t.split()
            mask = covered(np.unique(np.frombuffer(found or b"", "<u4")).astype(np.int64), len(tokens))
            text = b" ".join(w for w, m in zip(tokens, mask.tolist(), strict=True) if not m)
            gone.append(int(mask.sum()))
            kept.append(text)
            sha.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_words"), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def _parts(docs: DataFrame, text: str | Column) -> int:
    """Parts for the packed hashes, from the bytes of the texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // PART_BYTES))


def repeated_words(docs: DataFrame, *, texts: bool = False) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text (null: nothing was removed)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    keyed = keyed.select("doc_id", F.unhex(row_key("doc_id", "text")).alias("key"), "text")
    parts = _parts(keyed, F.col("text"))
    found = _repeated(keyed.select("key", "text"), _anchored, parts)
    left = keyed.join(found, "key", "left").mapInArrow(_whole, "doc_id long, key binary, pos binary, n_words long, kept_sha256 string, text string")
    left = written(left, "cover-anchored", free=True)
    near = left.where("pos is not null")
    starts = _repeated(near.select("key", "text", "pos"), _windowed, parts).withColumnRenamed("pos", "starts")
    cut = near.select("key", "doc_id", "n_words", "text").join(starts, "key", "left").select("doc_id", "n_words", "text", "starts")
    cut = cut.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    done = left.where("pos is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    out = done.unionByName(cut)
    return out if texts else out.drop("kept_text")


def brute_force(texts: list[str | None]) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) of each text by counting all windows, for tests."""
    tokens = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for w in tokens:
        for i in range(len(w) - WINDOW + 1):
            seen[tuple(w[i : i + WINDOW])] = seen.get(tuple(w[i : i + WINDOW]), 0) + 1
    out = []
    for w in tokens:
        gone = set()
        for i in range(len(w) - WINDOW + 1):
            if seen[tuple(w[i : i + WINDOW])] > 1:
                gone.update(range(i, i + WINDOW))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out

"""Byte-level BPE: a lazily determinised finite-state transducer encodes, a UTF-8 state machine decodes.

The merges (the ranks of a rank file) are compiled into a nondeterministic
transducer over bytes. Its states are (last token, place in the trie of the
token that is being read); a token may end where the trie has one, if it goes
together with the last: two neighbours go together if their bytes, merged
again by rank, come out as the same two. For every prefix of the input exactly
one path stands at the end of a token: the encoding of that prefix.

Determinisation keeps all paths that are still alive side by side, each with
the tokens that it has and the others do not; what they share is emitted at
once. A path lives only while the bytes since its last token begin some token,
so a token is emitted after a lookahead bounded by the longest token. States
and arcs are made when an input first asks for them, and all are dropped when
there are ``STATES`` of them, so memory stays bounded for any input.

Text is cut by the pattern of the rank file; each match is encoded alone. A
match that is itself a token is that token, as in the public library (it
matters only for tokens that no merges reach). Results of short matches are
kept in a bounded memo.

Decoding is a transducer as well: its state is the bytes of a character that
is not complete (three at most); a token's bytes give text and the next state.
Ids can so be decoded as they come; what is no UTF-8 becomes U+FFFD, one for
each longest part that could have begun a character. Ids outside the
vocabulary raise ValueError.

Null text is empty and has no tokens; null ids are empty. Texts of any length
are encoded whole, in linear time. Repeated rows are encoded one by one, empty
tables give no rows, and further columns are read only where they are to be kept.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .piece_codec import Memo, read_model

#: Most states of the transducer that are kept at a time, and most pairs of tokens.
STATES, PAIRS = 250_000, 400_000
ROOT = 0
#: First byte of a longer character -> (bytes after it, least and greatest second byte).
LEADS = (
    {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}
    | {b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)} | {0xE0: (2, 0xA0, 0xBF), 0xED: (2, 0x80, 0x9F)}
    | {b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)} | {0xF0: (3, 0x90, 0xBF), 0xF4: (3, 0x80, 0x8F)}
)


class State:
    """A set of paths, (last token, trie node, own tokens) each, with the arcs that were asked for."""

    __slots__ = ("arcs", "paths", "rest")

    def __init__(self, paths: tuple) -> None:
        self.paths = paths
        self.arcs: dict[int, tuple[State, tuple[int, ...]]] = {}
        #: What remains to be emitted if the input ends here.
        self.rest = paths[0][2]


class Utf8Stream:
    """Text from bytes as they come: ``feed`` returns the characters that are complete, ``end`` what is left."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def step(held: bytes, data: bytes) -> tuple[str, bytes]:
        """(text, bytes of the unfinished character) of ``data`` after ``held``."""
        out, raw = [], bytearray(held)
        need, low, high = Utf8Stream._needs(raw)
        for b in data:
            if raw:
                if low <= b <= high:
                    raw.append(b)
                    need, low, high = need - 1, 0x80, 0xBF
                    if not need:
                        out.append(raw.decode())
                        raw.clear()
                    continue
                out.append("�")
                raw.clear()
            if b < 0x80:
                out.append(chr(b))
            elif b in LEADS:
                raw.append(b)
                need, low, high = LEADS[b]
            else:
                out.append("�")
        return "".join(out), bytes(raw)

    @staticmethod
    def _needs(raw: bytearray) -> tuple[int, int, int]:
        if not raw:
            return 0, 0, 0
        need, low, high = LEADS[raw[0]]
        return (need, low, high) if len(raw) == 1 else (need + 1 - len(raw), 0x80, 0xBF)

    def feed(self, data: bytes) -> str:
        text, self.held = self.step(self.held, data)
        return text

    def end(self) -> str:
        held, self.held = self.held, b""
        return "�" if held else ""


def ascii_only(pattern: str) -> str:
    """The pattern for texts of ASCII characters: letters and digits spelt out, which the built-in engine reads faster."""
    out, inside, k = [], False, 0
    classes = {r"\p{L}": "a-zA-Z", r"\p{N}": "0-9"}
    while k < len(pattern):
        if (name := pattern[k : k + 5]) in classes:
            out.append(classes[name] if inside else f"[{classes[name]}]")
            k += 5
            continue
        c = pattern[k : k + 2] if pattern[k] == "\\" else pattern[k]
        inside = c == "[" or inside and c != "]"
        out.append(c)
        k += len(c)
    return "".join(out)


class ByteCodec:
    def __init__(self, ranks: bytes, pattern: str, memo: int = 220_000) -> None:
        self.rank: dict[bytes, int] = {}
        for line in ranks.splitlines():
            if line.strip():
                token, _, i = line.partition(b" ")
                self.rank[base64.b64decode(token)] = int(i)
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every single byte")
        self.token = {i: t for t, i in self.rank.items()}
        if len(self.token) != len(self.rank):
            raise ValueError("tokens of equal rank")
        self.cut = regex.compile(pattern)
        self.ascii_cut = re.compile(ascii_only(pattern), re.ASCII)
        self._compile()
        self.states: dict[tuple, State] = {}
        self.start = self._state(((-1, ROOT, ()),))
        self.ok: dict[int, bool] = {}
        self.memo = Memo(self._remembered, memo)
        self.other: dict[str, str] = {}
        self.read: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    def _compile(self) -> None:
        """The trie of the tokens that merges reach, and the last merge of each."""
        child: dict[int, int] = {}
        ends: dict[int, int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        nodes = 1
        for t, i in self.rank.items():
            if len(t) > 1:
                parts = self.merged([t[k : k + 1] for k in range(len(t))], stop=2)
                if len(parts) != 2:
                    continue
                self.split[i] = (self.rank[parts[0]], self.rank[parts[1]])
            at = ROOT
            for b in t:
                down = child.get(at << 8 | b)
                if down is None:
                    down = child[at << 8 | b] = nodes
                    nodes += 1
                at = down
            ends[at] = i
        inner = {k >> 8 for k in child}
        #: node << 8 | byte -> (node below, token that ends there or -1, whether tokens go on from there).
        self.child = {k: (down, ends.get(down, -1), down in inner) for k, down in child.items()}

    def merged(self, parts: list[bytes], stop: int = 1) -> list[bytes]:
        """Merge by rank, leftmost first, until ``stop`` parts are left or none go together. For tokens."""
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def goes(self, left: int, right: int) -> bool:
        """Whether the two tokens, merged again from their bytes, stay these two."""
        key = left << 24 | right
        known = self.ok.get(key)
        if known is None:
            if len(self.ok) >= PAIRS:
                self.ok.clear()
            known = self.ok[key] = self._goes(left, right)
        return known

    def _goes(self, left: int, right: int) -> bool:
        """Undo merges beside the seam, latest first; none over the seam may come before one that was undone."""
        undone, was_right = None, False
        while True:
            over = self.rank.get(self.token[left] + self.token[right])
            if over is not None and (undone is None or over < undone or over == undone and was_right):
                return False
            a, b = (left if left in self.split else -1), (right if right in self.split else -1)
            if a < 0 and b < 0:
                return True
            # Of equal merges the left one comes first, so the right one is undone first.
            if a > b:
                undone, was_right, left = a, False, self.split[left][1]
            else:
                undone, was_right, right = b, True, self.split[right][0]

    def _state(self, paths: tuple) -> State:
        found = self.states.get(paths)
        if found is None:
            found = self.states[paths] = State(paths)
        return found

    def _arc(self, at: State, b: int) -> tuple[State, tuple[int, ...]]:
        """The arc of ``at`` under a byte: where all paths go, and the tokens that they come to share.

        The path that stands at the end of a token comes first, the others
        follow from the latest to the earliest start, so equal sets are equal tuples.
        """
        if len(self.states) >= STATES:
            self.states.clear()
            self.start.arcs.clear()
            at.arcs.clear()
            self.states[self.start.paths] = self.start
            gc.collect()
        child, ok = self.child, self.ok
        ended, open_, waits = None, [], True
        for last, node, own in at.paths:
            below = child.get(node << 8 | b)
            if below is None:
                continue
            down, token, goes_on = below
            if token >= 0 and ended is None:
                known = last < 0 or ok.get(last << 24 | token)
                if known is None:
                    known = self.goes(last, token)
                if known:
                    ended = (token, ROOT, (*own, token))
            if goes_on:
                open_.append((last, down, own))
                if not own:
                    waits = False
        shared, first = 0, ended[2]
        if waits:
            while shared < len(first) and all(len(own) > shared and own[shared] == first[shared] for *_, own in open_):
                shared += 1
        if shared:
            paths = ((ended[0], ROOT, first[shared:]), *[(last, down, own[shared:]) for last, down, own in open_])
        else:
            paths = (ended, *open_)
        arc = at.arcs[b] = (self._state(paths), first[:shared])
        return arc

    def run(self, data: bytes):
        """Tokens of ``data`` in order, each as soon as the bytes read so far decide it."""
        at = self.start
        for b in data:
            at, out = at.arcs.get(b) or self._arc(at, b)
            if out:
                yield from out
        yield from at.rest

    def match(self, s: str) -> list[int]:
        data = s.encode()
        whole = self.rank.get(data)
        return [whole] if whole is not None else list(self.run(data))

    def matches(self, text: str) -> list[str]:
        return (self.ascii_cut if text.isascii() else self.cut).findall(text)

    def encode(self, text: str) -> list[int]:
        return [i for s in self.matches(text) for i in self.match(s)]

    def _remembered(self, s: str) -> str:
        """The ids of a match, each behind a space; matches that decode to another text are noted."""
        ids = self.match(s)
        shown = self.decode(ids)
        if shown != s:
            self.other[s] = shown
        return " " + " ".join(map(str, ids))

    def decode_from(self, ids, held: bytes = b"") -> tuple[str, bytes]:
        """(text, bytes of the unfinished character) of ``ids`` after ``held``; goes on from where it stopped."""
        out, read = [], self.read
        for i in ids:
            step = read.get((held, i))
            if step is None:
                if i not in self.token:
                    raise ValueError(f"{i} is no id of the vocabulary")
                if len(read) >= PAIRS:
                    read.clear()
                step = read[held, i] = Utf8Stream.step(held, self.token[i])
            out.append(step[0])
            held = step[1]
        return "".join(out), held

    def decode(self, ids) -> str:
        text, held = self.decode_from(ids)
        return text + "�" if held else text

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, their decimal digits joined by spaces, decoded text)."""
        self.memo.turn()
        parts = self.matches(text)
        ids = "".join(map(self.memo.__getitem__, parts))
        # A match holds whole characters, so none goes on in the next.
        shown = "".join(parts) if not self.other else "".join([self.other.get(s, s) for s in parts])
        return ids.count(" "), ids[1:], shown


_CODECS: dict[bytes, ByteCodec] = {}


def codec(ranks: bytes, pattern: str) -> ByteCodec:
    """One codec a worker process."""
    at = hashlib.sha256(ranks + pattern.encode()).digest()
    if at not in _CODECS:
        _CODECS[at] = ByteCodec(ranks, pattern)
    return _CODECS[at]


def encode_documents(docs: DataFrame, path: str, pattern: str, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, the columns ``keep`` as they are, n_tokens, ids and the text decoded from them."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches):
        c = codec(ranks.value, pattern)
        gc.disable()  # cycles are states alone, and are collected when states are dropped
        for b in batches:
            counts, listed, decoded = [], [], []
            for t in b.column("text").to_pylist():
                n, ids, shown = c.digest(t)
                counts.append(n)
                listed.append(ids)
                decoded.append(shown)
            ids = np.fromstring(" ".join(x for x in listed if x), dtype=np.int32, sep=" ")
            ends = np.cumsum([0, *counts]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(b.column(f"_bc_{k}") for k in range(len(keep))), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(decoded, pa.string())],
                names=["doc_id", *(f"_bc_{k}" for k in range(len(keep))), "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), *(F.col(c).alias(f"_bc_{k}") for k, c in enumerate(keep)), text_of("text").alias("text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    schema = schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"_bc_{k}": c for k, c in enumerate(keep)})


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) of ``rows(doc_id, ids)``."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches):
        c = codec(ranks.value, pattern)
        for b in batches:
            out = [c.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded string")

"""Exact SentencePiece (merge type) encoding and decoding by backtracking.

Merging by rank has one result for every text, and a token sequence is that
result exactly if every two neighbours, merged again from their characters,
come out as the same two tokens. So the encoder takes the longest token that
an Aho-Corasick automaton finds at the present position, checks it against its
left neighbour, steps down to shorter tokens where they do not go together,
and notes positions from which no token continues in a bitfield, so that none
is tried twice.

No token spans the boundary of a white-space mark after another character, and
letters and other characters meet in no token unless listed by the model; the
text is cut there, and the encodings of short segments are kept in a bounded
memo. The model file is only read: nothing is trained.

Null text is empty and has no tokens; characters outside the vocabulary become
byte tokens (or the unknown token where the model has none). Texts of any
length are encoded whole. Repeated rows are encoded one by one, empty tables
give no rows, and further columns are read only where they are to be kept.
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(buf: bytes):
    """(number, value) of a protocol-buffer message: varints as int, the rest as bytes."""
    i, n = 0, len(buf)

    def varint(i):
        out = shift = 0
        while True:
            b = buf[i]
            out |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return out, i

    while i < n:
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            v, i = buf[i : i + size], i + size
        else:
            size = 8 if kind == 1 else 4
            v, i = buf[i : i + size], i + size
        yield key >> 3, v


class Memo(dict):
    """Results by segment in two generations: a full one becomes the older one, from which what is used again comes back. Long segments are not kept."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, s: str):
        made = self.older.get(s) or self.make(s)
        if len(s) <= 48 and len(self) < 2 * self.limit:
            self[s] = made
        return made

    def turn(self) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()


class PieceCodec:
    def __init__(self, model: bytes, memo: int = 160_000) -> None:
        pieces, self.dummy, squeeze, charsmap, bpe, self.unk_surface = [], True, True, b"", False, " ⁇ "
        for num, v in _fields(model):
            if num == 1:
                f = dict(_fields(v))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif num == 2:
                f = dict(_fields(v))
                bpe, suffix = f.get(3, 1) == 2, bool(f.get(24, 0))
                self.unk_surface = f[44].decode() if 44 in f else self.unk_surface
            elif num == 3:
                f = dict(_fields(v))
                charsmap, self.dummy, squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
                escape = bool(f.get(5, 1))
        if not bpe or suffix or charsmap or squeeze or not escape or any(k in (USER, UNUSED) for *_, k in pieces):
            raise ValueError("this codec reads merge-type models with identity normalisation and no user-defined pieces")
        self.surface = [p for p, *_ in pieces]
        self.kind = [k for *_, k in pieces]
        self.unk = self.kind.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        marks = {p for p, _, k in pieces if k == NORMAL and len(p) > 1 and set(p) == {MARK}}
        self.score = {p: s for p, s, k in pieces if k == NORMAL}
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        plain = [p for p in self.id if p not in marks and len(p) > 1]
        if len({self.score[p] for p in plain}) != len(plain):
            raise ValueError("pieces of equal rank")
        if marks and plain and max(self.score[p] for p in marks) >= min(self.score[p] for p in plain):
            raise ValueError("runs of the white-space mark must have the lowest rank")
        self.marks = marks
        self.chars = {p for p in self.id if len(p) == 1}
        self.shown = [p.replace(MARK, " ") for p in self.surface]
        self.odd = {i for i, k in enumerate(self.kind) if k in (BYTE, CONTROL, UNKNOWN)}
        self.cut = not any(MARK in p.lstrip(MARK) for p in plain)
        self._splits(plain)
        self._pattern()
        self.ok: dict[int, bool] = {}
        self.memo = Memo(self._remembered, memo)
        self.digits = [str(i) for i in range(len(pieces))]

    def _splits(self, plain: list[str]) -> None:
        """For each reachable token the two tokens of its last merge; the automaton holds reachable tokens only."""
        self.split: dict[int, tuple[int, int]] = {}
        self.auto = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) == 1:
                self.auto.add_word(p, (1, i))
        for p in plain:
            parts = self.merged(list(p), stop=2)
            if len(parts) == 2:
                i = self.id[p]
                self.split[i] = (self.id[parts[0]], self.id[parts[1]])
                self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()
        self.pair = {v: k for k, v in self.split.items()}

    def merged(self, parts: list[str], stop: int = 1) -> list[str]:
        """Merge by rank, leftmost first, until ``stop`` parts are left or none go together. For short inputs."""
        score = self.score
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pattern(self) -> None:
        """Cut between letters and other characters wherever no token holds both kinds side by side.

        A letter that stands beside other characters in a token, and never
        beside a letter, counts as one of those. If pairs remain, texts are cut
        at marks only.
        """
        letter = re.compile(r"[^\W\d_]")
        pairs = {(a, b) for p in self.id for q in [p.lstrip(MARK)] for a, b in zip(q, q[1:], strict=False)}
        is_letter = {c: bool(letter.match(c)) for pair in pairs for c in pair}
        odd = {a if is_letter[a] else b for a, b in pairs if is_letter[a] != is_letter[b]}
        for c in odd:
            is_letter[c] = False
        clean = all(is_letter[a] == is_letter[b] for a, b in pairs)
        if not self.cut:
            self.segment = re.compile(r"(?s).+")
        elif not clean or "\n" in "".join(self.id):
            self.segment = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
        else:
            also = "".join(map(re.escape, sorted(odd)))
            inside = rf"(?:(?![{also}])[^\W\d_])+" if odd else r"[^\W\d_]+"
            other = rf"(?:(?![{MARK}\n])[\W\d_{also}])+"
            self.segment = re.compile(rf"{MARK}*{inside}|{MARK}*{other}|\n+|{MARK}+")

    def goes(self, left: int, right: int) -> bool:
        """Whether the two tokens, merged again from their characters, stay these two."""
        known = self.ok.get(left << 24 | right)
        if known is None:
            if len(self.ok) >= 300_000:
                self.ok.clear()
            known = self.ok[left << 24 | right] = self._goes(left, right)
        return known

    def _goes(self, left: int, right: int) -> bool:
        """Undo merges on both sides of the seam, latest first; a merge over the seam must not come before them."""
        rank = lambda i: self.score[self.surface[i]] if i in self.split else None
        bound = None  # the latest merge that has been undone; over the seam only later ones are allowed
        while True:
            over = self.pair.get((left, right))
            if over is not None and (bound is None or rank(over) > bound[0] or rank(over) == bound[0] and bound[1]):
                return False
            a, b = rank(left), rank(right)
            if a is None and b is None:
                return True
            # Of equal merges the left one comes first, so the right one is undone first.
            if b is None or a is not None and a < b:
                bound, left = (a, False), self.split[left][1]
            else:
                bound, right = (b, True), self.split[right][0]

    def _known(self, s: str) -> list[int]:
        """Tokens of a text of vocabulary characters, with at most one mark, at its start."""
        n = len(s)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, i) in self.auto.iter(s):
            at[end - size + 1].append((end + 1, i))
        if len(at[0]) and at[0][-1][0] == n:
            return [at[0][-1][1]]
        ok, goes = self.ok, self.goes
        failed = bytearray(n // 8 + 1)  # a bit for each position
        out: list[tuple[int, int, int]] = []
        found = at[0]
        pos, c, prev = 0, len(found) - 1, -1
        while True:
            while c >= 0:
                end, i = found[c]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if prev < 0:
                        break
                    known = ok.get(prev << 24 | i)
                    if known is None:
                        known = goes(prev, i)
                    if known:
                        break
                c -= 1
            if c >= 0:
                out.append((i, pos, c))
                if end == n:
                    return [x[0] for x in out]
                pos, prev, found = end, i, at[end]
                c = len(found) - 1
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                _, pos, c = out.pop()
                c -= 1
                found = at[pos]
                prev = out[-1][0] if out else -1

    def _marks(self, n: int) -> list[int]:
        """Tokens of a run of n marks: equal neighbours merge leftmost first, as their ranks say."""
        if n == 1 or not self.marks:
            return [self.id[MARK]] * n if MARK in self.id else [self.unk] * n
        longest = max(map(len, self.marks))
        if n <= 4 * longest:
            return [self.id[p] for p in self.merged([MARK] * n)]
        return self._long_marks(n)

    def _long_marks(self, n: int) -> list[int]:
        """Long runs by a queue of merges (rank, position), as a linked list."""
        import heapq

        size, nxt, prv = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)]
        score = {len(p): self.score[p] for p in self.marks}
        heap = [(-score[2], k, 2) for k in range(n - 1)] if 2 in score else []
        heapq.heapify(heap)
        while heap:
            _, k, total = heapq.heappop(heap)
            r = nxt[k] if size[k] else -1
            if r < 0 or size[k] + size[r] != total:
                continue
            size[k], size[r] = total, 0
            nxt[k] = nxt[r]
            if nxt[r] >= 0:
                prv[nxt[r]] = k
            for x in (prv[k], k):
                if x >= 0 and nxt[x] >= 0 and (t := size[x] + size[nxt[x]]) in score:
                    heapq.heappush(heap, (-score[t], x, t))
        return [self.id[MARK * s] for s in size if s]

    def _segment(self, s: str) -> list[int]:
        if s[:2] != MARK * 2 and self.cut and self.chars.issuperset(s):
            return self._known(s)
        out: list[int] = []
        for part in re.split(f"({MARK}+)", s) if not self.cut else [s]:
            body = part.lstrip(MARK)
            lead = len(part) - len(body)
            runs: list[int] = []
            # Maximal stretches of vocabulary characters; the last mark may join the first of them.
            stretch = MARK if lead else ""
            for ch in body:
                if ch in self.id:
                    stretch += ch
                else:
                    if stretch:
                        runs += self._known(stretch)
                        stretch = ""
                    runs += [self.bytes[b] for b in ch.encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]
            if stretch:
                runs += self._known(stretch)
            if lead > 1:
                alone = runs[0] == self.id[MARK]
                runs = self._marks(lead if alone else lead - 1) + runs[alone:]
            out += runs
        return out

    def _texts(self, ids: list[int]) -> str:
        """Surfaces joined, marks as spaces; byte tokens as UTF-8, a replacement character for each byte that is none."""
        if self.odd.isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kind[i] == BYTE:
                raw.append(int(self.surface[i][3:5], 16))
                continue
            k = 0
            while k < len(raw):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(raw[k : k + size]).decode())
                        k += size
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    k += 1
            raw.clear()
            if i is None or self.kind[i] == CONTROL:
                continue
            out.append(self.unk_surface if i == self.unk else self.shown[i])
        return "".join(out)

    def _remembered(self, s: str) -> tuple[str, int, str]:
        ids = self._segment(s)
        return "," + ",".join(map(self.digits.__getitem__, ids)), len(ids), self._texts(ids)

    def _segments(self, text: str) -> list[str]:
        if not text:
            return []
        return self.segment.findall((MARK if self.dummy else "") + text.replace(" ", MARK))

    def encode(self, text: str) -> list[int]:
        return [i for s in self._segments(text) for i in self._segment(s)]

    def decode(self, ids: list[int]) -> str:
        body = [i for i in ids if self.kind[i] != CONTROL]
        out = self._texts(body)
        return out[1:] if self.dummy and body and body[0] != self.unk and self.surface[body[0]].startswith(MARK) else out

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, their decimal digits joined by commas, decoded text)."""
        memo = self.memo
        memo.turn()
        parts = list(map(memo.__getitem__, self._segments(text)))
        if not parts:
            return 0, "", ""
        ids, counts, shown = zip(*parts, strict=True)
        n, decoded = sum(counts), "".join(shown)
        # With the dummy prefix the first token starts with a mark, which decoding drops.
        return n, "".join(ids)[1:], decoded[1:] if self.dummy and n else decoded


_CODECS: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec a worker process."""
    at = hashlib.sha256(model).digest()
    if at not in _CODECS:
        _CODECS[at] = PieceCodec(model)
    return _CODECS[at]


def read_model(path: str, most: int = 64 << 20) -> bytes:
    """The model file, read on the driver; its size is checked before it is sent to the executors."""
    with open(path, "rb") as f:
        model = f.read(most + 1)
    if len(model) > most:
        raise ValueError(f"{path} has over {most} bytes")
    return model


def encode_documents(docs: DataFrame, path: str, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, the columns ``keep`` as they are, n_tokens, ids and the text decoded from them."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches):
        c = codec(model.value)
        for b in batches:
            counts, listed, decoded = [], [], []
            for t in b.column("text").to_pylist():
                n, ids, shown = c.digest(t)
                counts.append(n)
                listed.append(ids)
                decoded.append(shown)
            ids = np.fromstring(",".join(x for x in listed if x), dtype=np.int32, sep=",")
            ends = np.cumsum([0, *counts]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(b.column(f"_pc_{k}") for k in range(len(keep))), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(decoded, pa.string())],
                names=["doc_id", *(f"_pc_{k}" for k in range(len(keep))), "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), *(F.col(c).alias(f"_pc_{k}") for k, c in enumerate(keep)), text_of("text").alias("text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    schema = schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"_pc_{k}": c for k, c in enumerate(keep)})


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of ``rows(doc_id, ids)``; null ids are empty."""
    model = rows.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches):
        c = codec(model.value)
        for b in batches:
            out = [c.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded string")

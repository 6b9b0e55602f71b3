"""Removal of repeated line chunks in plain Python, line by line: nothing of it is shared with the operator."""

import hashlib

import xxhash

FULL = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & FULL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & FULL
    return x ^ x >> 31


def pieces(text):
    """(start, lines) of each chunk: it ends after a line where the hash over the last two lines is even, has two to 64 lines, or is the rest."""
    lines, out, open_, before = text.split(b"\n"), [], [], 0
    for i, line in enumerate(lines):
        here = xxhash.xxh3_64_intdigest(line)
        open_.append(line)
        even = mix((here * 0x9E3779B97F4A7C15 + before * 0xC2B2AE3D27D4EB4F) & FULL) % 2 == 0
        before = here
        if len(open_) > 64:
            out.append(open_[:64])
            open_ = open_[64:]
        if even and len(open_) >= 2 or i == len(lines) - 1 and open_:
            out.append(open_)
            open_ = []
    return out


def removed(rows):
    """The texts that are left, of rows (doc_id, text), all different."""
    parsed, first = [], {}
    for doc_id, text in rows:
        digest = hashlib.md5(f"{doc_id if doc_id is not None else chr(0)}\u0001{text if text is not None else chr(0)}".encode()).hexdigest()
        found = [(k, p, len(p) > 1 and sum(bool(x.split()) for x in p) > 1) for k, p in enumerate(pieces((text or "").encode()))]
        parsed.append(((doc_id is None, doc_id or 0, digest), found))
        for k, p, named in found:
            if named:
                first[tuple(p)] = min(first.get(tuple(p), (True, 1 << 62, "~", 0)), (*parsed[-1][0], k))
    return [b"\n".join(x for k, p, named in found if not named or first[tuple(p)] == (*me, k) for x in p).decode() for me, found in parsed]

"""The byte-level codec against the public library, and its decoder against Python's."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import byte_codec, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


def parts(name):
    raw = open(public_tokenizers.path(name), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return raw, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


CODECS = {name: (byte_codec.codec(parts(name)[0], public_tokenizers.PATTERN), parts(name)[1]) for name in FILES}


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60) | st.text("abt ehnrs'.\n", max_size=80))
def test_any_text(name, text):
    codec, library = CODECS[name]
    text = text.encode("utf-8", "ignore").decode()
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text
    n, listed, shown = codec.digest(text)
    assert (n, listed, shown) == (len(ids), " ".join(map(str, ids)), text)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.integers(0, 50_255), max_size=12), cut=st.integers(0, 12))
def test_any_ids(name, ids, cut):
    codec, library = CODECS[name]
    assert codec.decode(ids) == library.decode(ids, errors="replace")
    head, held = codec.decode_from(ids[:cut])
    tail, rest = codec.decode_from(ids[cut:], held)
    assert head + tail + ("�" if rest else "") == codec.decode(ids)


@given(data=st.binary(max_size=20), cut=st.integers(0, 20))
def test_bytes_as_they_come(data, cut):
    stream = byte_codec.Utf8Stream()
    got = stream.feed(data[:cut]) + stream.feed(data[cut:]) + stream.end()
    assert got == data.decode("utf-8", "replace")


def test_tokens_joined_at_random():
    rng = random.Random(5)
    for codec, library in CODECS.values():
        tokens = list(codec.rank)
        for _ in range(2000):
            text = b"".join(rng.choice(tokens) for _ in range(rng.randrange(9))).decode("utf-8", "ignore")
            assert codec.encode(text) == library.encode_ordinary(text)


def test_lookahead_and_states_are_bounded(monkeypatch):
    codec, library = CODECS[FILES[0]]
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    monkeypatch.setattr(byte_codec, "STATES", 300)
    assert codec.encode(text) == library.encode_ordinary(text)
    assert len(codec.states) <= 301
    longest = max(map(len, codec.rank))
    at, read, told = codec.start, 0, 0
    for b in text.encode():
        at, out = at.arcs.get(b) or codec._arc(at, b)
        read, told = read + 1, told + sum(len(codec.token[i]) for i in out)
        assert read - told <= 2 * longest


def test_rank_files_that_are_none():
    with pytest.raises(ValueError):
        byte_codec.ByteCodec(b"YQ== 0\n", public_tokenizers.PATTERN)
    with pytest.raises(ValueError):
        CODECS[FILES[0]][0].decode([60_000])


def test_documents(spark):
    long_ = "lorem ipsum " * 30_000 + "x" * 50_000
    texts = [(1, None), (2, ""), (3, " \n\t "), (None, "no id"), (4, long_), (4, long_), (5, "ünï 😀 \x00 <|endoftext|>"), (6, "it's  we'll 　 1٣")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOCS).selectExpr("*", "'clash' as ids", "1 as n_tokens")
    path = public_tokenizers.path(FILES[0])
    library = CODECS[FILES[0]][1]
    rows = byte_codec.encode_documents(docs, path, public_tokenizers.PATTERN, keep=("source",)).collect()
    want = sorted((str(i), library.encode_ordinary(t or ""), t or "") for i, t in texts)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) and r.source is None for r in rows)
    back = byte_codec.decode_ids(spark.createDataFrame([(1, [220, 50]), (2, None), (3, [])], "doc_id long, ids array<int>"), path, public_tokenizers.PATTERN)
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: library.decode([220, 50]), 2: "", 3: ""}
    assert byte_codec.encode_documents(docs.where("false"), path, public_tokenizers.PATTERN).count() == 0


def test_query(spark, sf_dir):
    library = CODECS[FILES[0]][1]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op13_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()

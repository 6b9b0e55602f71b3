"""Loaders, URLs and raw storage."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgraph.sources import loaders, urls


@pytest.mark.parametrize("ext,raw,text", [
    (".txt", b"\xef\xbb\xbfa\x00b", "ab"), (".json", b'{"z":2,"a":{"b":1},"list":[true,null]}', '{\n  "a": {\n    "b": 1\n  },\n  "list": [\n    true,\n    null\n  ],\n  "z": 2\n}\n'),
    (".csv", b"a,b\r\n1,2\r\n", "a,b\n1,2\n"), (".html", b"<div>Visible<br>Text</div>", "Visible\nText"),
    (".html", b"<h1>Title</h1><p>Hello <strong>world</strong>.</p><noscript>no</noscript><ul><li>First<li>Second</ul>", "Title\nHello world.\nFirst\nSecond"),
])
def test_formats(ext, raw, text):
    assert loaders.load_one(ext, raw) == (text, None)


@pytest.mark.parametrize("ext,raw", [(".txt", b""), (".txt", b"a\x01"), (".txt", b"\xff\xfe"), (".json", b"{"), (".csv", b'"open'), (".csv", b""), (".html", b"<script>x</script>"), (".pdf", b"x"), (".docx", b"x"), (".exe", b"x")])
def test_rejected(ext, raw):
    text, error = loaders.load_one(ext, raw)
    assert text is None and error


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
    assert loaders.load_one(".docx", buf.getvalue()) == ("Hello\na\tb", None)


def test_load_files(spark):
    rows = [("C:\\x\\a.TXT", b"one\r\ntwo\rthree"), ("..", b"x"), ("b.json", b"[1"), (None, b"x"), ("big.txt", b"x" * 50), ("c.md", None)]
    got = {r.filename: r for r in loaders.load_files(spark.createDataFrame(rows, "filename string, content binary"), most=40).collect()}
    assert got["a.TXT"].normalized_text == "one\ntwo\nthree" and got["a.TXT"].error is None and got["a.TXT"].mime_type == "text/plain"
    assert got["b.json"].error == "not JSON" and got["big.txt"].error == "too large" and got[None].error == "no file name" and got["c.md"].error
    good, bad = loaders.split_quarantine(loaders.load_files(spark.createDataFrame(rows, "filename string, content binary"), most=40))
    assert good.count() == 1 and bad.count() == 5


def test_raw_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d", "s1", ".txt", b"abc"), ("d", "s2", ".md", b"xyz")], "dataset_id string, source_id string, extension string, content binary").withColumn("content_sha256", F.sha2("content", 256))
    kept = loaders.store_raw(rows, str(tmp_path / "raw"))
    wanted = kept.select("source_id", "storage_uri", "content_sha256", F.lit(3).cast("long").alias("size_bytes"))
    got = {r.source_id: r for r in loaders.reread_raw(spark, str(tmp_path / "raw"), wanted).collect()}
    assert got["s1"].intact and bytes(got["s1"].content) == b"abc"
    bad = loaders.reread_raw(spark, str(tmp_path / "raw"), wanted.withColumn("size_bytes", F.lit(4).cast("long"))).where("intact").count()
    assert bad == 0
    out = loaders.raw_deletion(spark.createDataFrame([("s1",), ("s9",)], "source_id string"), kept, F.lit(True))
    assert {r.source_id: r.raw_outcome for r in out.collect()} == {"s1": "deleted", "s9": "absent"}


def test_metadata(spark):
    rows = spark.createDataFrame([("",), ('{"a":1}',), ("[1]",), ("{",), (None,)], "m string").select(loaders.form_metadata("m").alias("x")).collect()
    assert [(r.x.metadata, r.x.error is None) for r in rows] == [("{}", True), ('{"a": 1}', True), (None, False), (None, False), ("{}", True)]


@pytest.mark.parametrize("url,want", [
    ("https://A.example/p#f", "https://A.example/p"), (" https://a.example ", "https://a.example/"), ("http://a.example/", None), ("https://u:p@a.example/", None), ("https://localhost/x", None),
    ("https://x.localhost/", None), ("https://a.example:99999/", None), ("https:///x", None), ("https://a.example?q=1", "https://a.example/?q=1"),
])
def test_url(url, want):
    assert urls.normalized_url(url) == want


@pytest.mark.parametrize("ip,ok", [("8.8.8.8", True), ("10.0.0.1", False), ("127.0.0.1", False), ("169.254.169.254", False), ("100.100.100.200", False), ("::1", False), ("2606:4700::1", True), ("x", False), ("224.0.0.1", False)])
def test_address(ip, ok):
    assert urls.public_address(ip) == ok


def test_fetch(spark):
    pages = spark.createDataFrame([
        ("https://a.example/", 302, "https://b.example/doc.html", None, None, "8.8.8.8"), ("https://b.example/doc.html", 200, None, "text/html; charset=utf-8", b"hi", "8.8.8.8"),
        ("https://loop.example/", 301, "https://loop.example/", None, None, "8.8.8.8"), ("https://in.example/", 200, None, "text/plain", b"x", "10.0.0.1"), ("https://img.example/", 200, None, "image/png", b"x", "8.8.8.8"),
    ], "url string, status int, location string, content_type string, body binary, address string")
    asked = spark.createDataFrame([(u,) for u in ("https://a.example", "https://loop.example/", "https://in.example/", "https://img.example/", "http://x.example", "https://none.example/")], "url string")
    got = {r.url: r for r in urls.fetch(asked, pages).collect()}
    assert len(got) == 6
    assert got["https://a.example"].filename == "doc.html" and bytes(got["https://a.example"].content) == b"hi" and got["https://a.example"].error is None
    assert got["https://loop.example/"].error == "redirect loop" and got["https://in.example/"].error == "blocked network"
    assert got["https://img.example/"].error == "unsupported media type" and got["http://x.example"].error == "URL refused" and got["https://none.example/"].error == "unavailable"

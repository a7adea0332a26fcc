"""Answers for addresses, and formats by their bytes."""

from __future__ import annotations

import gzip
import io
import zipfile

from pyspark.sql import functions as F

from cairn.functions import signatures as G
from cairn.operators import replay as R


def test_targets(spark):
    pages = [(1, 1, "http://www.a/", False), (1, 2, "http://a/p?x=1", True), (1, 3, "http://a/p?x=1", True), (1, 4, "https://b:8443/", True), (2, 1, "http://c/", False)]
    captured = spark.createDataFrame(pages, "job int, nr int, url string, page boolean")
    wanted = [(1, "http://www.a:80/#top"), (1, "HTTP://A"), (1, "http://www.a/p?x=1#f"), (1, "http://z/"), (1, None), (1, "https://www.b:8443/"), (1, "https://b/"), (2, "http://z/"), (2, None), (3, "odd")]
    got = {(r.job, r.url): (r.target, r.reason) for r in R.targets(spark.createDataFrame(wanted, "job int, url string"), captured, "job", "nr").collect()}
    first = "http://a/p?x=1"
    assert got == {
        (1, "http://www.a:80/#top"): ("http://www.a/#top", "exact"), (1, "HTTP://A"): ("http://www.a/", "host-alias"), (1, "http://www.a/p?x=1#f"): (first + "#f", "host-alias"), (1, "http://z/"): (first, "fallback"), (1, None): (first, "auto"),
        (1, "https://www.b:8443/"): ("https://b:8443/", "host-alias"), (1, "https://b/"): (first, "fallback"), (2, "http://z/"): ("http://z/", "unverified"), (2, None): (None, "unverified"), (3, "odd"): ("odd", "unverified"),
    }
    rows = spark.createDataFrame([("response", 200, "Text/HTML; x", 5), ("response", 200, "text/html", 0), ("revisit", 200, "text/html", 0), ("response", 404, "text/html", 5), ("response", None, None, None)], "t string, s int, m string, l long")
    assert [r[0] for r in rows.select(R.is_page(F.col("t"), F.col("s"), F.col("m"), F.col("l"))).collect()] == [True, False, True, False, False]


def test_archived_pages(spark):
    pages = spark.createDataFrame([("s", 1, "http://www.a/"), ("s", 2, "https://a"), ("s", 3, "http://a/b?q")], "site string, nr int, url string")
    wanted = spark.createDataFrame([("s", "https://a"), ("s", "http://a:81/"), ("s", "http://www.a/b?q"), ("s", "http://a/c"), ("t", "https://a"), ("s", None)], "site string, url string")
    got = [(r.url, r.page) for r in R.archived_pages(wanted, pages, "site", "nr").collect() if r.site == "s"]
    assert dict(got) == {"https://a": "https://a", "http://a:81/": "http://www.a/", "http://www.a/b?q": "http://a/b?q", "http://a/c": None, None: None}


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
    return out.getvalue()


def test_formats(spark):
    bodies = [
        (b"%PDF-1.7 x", "text/html", ("pdf", "signature")), (b"\n" * 30 + b"%PDF-1.4", "application/pdf; x", ("pdf", "served")), (b"\x89PNG\r\n\x1a\n", None, ("png", "signature")), (b"\x89PNG\r\n\x1a", None, None), (b"GIF89a..", "IMAGE/GIF", ("gif89a", "served")),
        (b"RIFF1234WEBPVP8 ", "image/webp", ("webp", "served")), (b"RIFF1234AVI ", "video/avi", ("riff", "signature")), (b"\0\0\0\x18ftypmp42", "video/mp4", ("mp4", "served")), (epub(), "application/zip", ("epub", "signature")), (gzip.compress(b"x"), "", ("gzip", "signature")),
        (b"{\\rtf1 x}\n", "text/rtf", ("rtf", "signature")), (b"{\\rtf1 x", "text/rtf", None), (b'<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml">', "text/html", ("xhtml", "signature")), (b"<?xml?><a/>", "application/xml", ("xml", "served")), (b"", "image/png", None), (None, "image/png", None), (b"plain", "text/plain", None),
    ]
    rows = spark.createDataFrame([(i, b, s) for i, (b, s, _) in enumerate(bodies)], "i int, body binary, served string")
    got = rows.select("i", G.identified(F.col("body"), F.col("served")).alias("f")).orderBy("i").collect()
    assert [(r.f.format, r.f.by) if r.f else None for r in got] == [w for *_, w in bodies]
    assert G.Mark("FF??0a", 1, 2).pattern() == "^(?:[0-9A-F]{2}){1,2}FF[0-9A-F]{2}0A"

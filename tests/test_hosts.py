"""Links, escapes and suffixes of hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import urls as U


def test_links_are_resolved(spark):
    vectors = [
        ("http://h/a/b/c?x#y", "d", "http://h/a/b/d"), ("http://h/a/b/c", "../d", "http://h/a/d"), ("http://h/a/b/c", "../../../../d", "http://h/d"), ("http://h/a/b/c", "./d/.", "http://h/a/b/d/"),
        ("http://h/a/b/", "..", "http://h/a/"), ("http://h", "d", "http://h/d"), ("http://h", "", "http://h/"), ("http://h/a?b=1", "#z", "http://h/a?b=1#z"), ("http://h/a?b=1", "?c", "http://h/a?c"), ("https://h:81/a", "//g/x/../y", "https://g/y"),
        ("http://h/a", "HTTPS://G/./y?../z", "https://G/y?../z"), ("http://h/a", "mailto:x@y", None), ("http://h/a", "javascript:void(0)", None), ("http://h/a/", " b c ", "http://h/a/b c"), ("no base", "x", None), ("http://h/a", "/", "http://h/"), ("http://h/a/b", "c:8/../d", None), ("http://h/a/b", "./c:8", "http://h/a/c:8"), ("http://h/a", None, None),
    ]
    rows = spark.createDataFrame(vectors, "base string, link string, want string")
    assert [r for r in rows.select("base", "link", U.resolved(F.col("base"), F.col("link")).alias("got"), "want").collect() if r.got != r.want] == []


def test_escapes_have_one_form(spark):
    vectors = [
        ("http://h/%41%7e%20 %", "http://h/A~%20%20%25"), ("http://h/?a=%20 b%2B", "http://h/?a=++b+"), ("http://h/%C3%A9é%E6%BC%A2漢😀", "http://h/éé%e6%bc%a2%e6%bc%a2%f0%9f%98%80"), ("http://h/%5C\\%23%25", "http://h/%5c%5c%23%25"), ("http://h/%zz%c3%", "http://h/%25zz%c3%25"), ("", ""), (None, None),
    ]
    rows = spark.createDataFrame(vectors, "url string, want string")
    assert [r for r in rows.select("url", U.escaped(F.col("url")).alias("got"), "want").collect() if r.got != r.want] == []
    forms = rows.limit(3).select(U.escaped(F.col("url"), high_order=False, low_order=False)).collect()
    assert forms[2][0] == "http://h/%c3%a9%c3%a9%e6%bc%a2%e6%bc%a2%f0%9f%98%80" and forms[0][0] == "http://h/%41%7e%20%20%25"
    more = [("https://www.example.com/foo?p=https:%2F%2Fwww.example.com%2Fother%2F", "http://example.com/foo?p=https://www.example.com/other"), ("http://www.example.com", "http://example.com/"), ("http://example.com/faulty%g/", "http://example.com/faulty%25g")]
    rows = spark.createDataFrame(more, "url string, want string")
    assert [r for r in rows.select("url", U.canonical(F.col("url")).alias("got"), "want").collect() if r.got != r.want] == []


def test_hosts_and_suffixes(spark):
    names = spark.createDataFrame([("BÜCHER.example.",), ("plain.Example",), (None,), ("a..b",)], "n string")
    assert [r[0] for r in names.select(U.ascii_host("n")).collect()] == ["xn--bcher-kva.example", "plain.example", None, None]
    rules = spark.createDataFrame([(r,) for r in (" COM ", "*.ck", "!www.ck", "b.c.d")], "rule string")
    hosts = ["a.b.com", "com", "x.y.ck", "y.ck", "a.www.ck", "www.ck", "z.b.c.d", "c.d", "1.2.3.4", "", None, "a.b.com"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, host string")
    got = [(r.public_suffix, r.private_suffix) for r in U.with_suffixes(rows, "host", rules).orderBy("i").collect()]
    assert got == [("com", "b.com"), ("com", "com"), ("y.ck", "x.y.ck"), ("y.ck", "y.ck"), ("ck", "www.ck"), ("ck", "www.ck"), ("b.c.d", "z.b.c.d"), ("d", "c.d"), (None, "1.2.3.4"), (None, ""), (None, None), ("com", "b.com")]

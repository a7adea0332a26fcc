"""Secrets taken out of requests and bodies, states replaced as a whole, links and parents of records."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import platforms
from cairn.functions import redaction as R
from cairn.operators import search_documents as D
from cairn.sources import state

KEYS = frozenset({"pass", "token"})


def request(body, kind=None, url=None):
    out = R.clean_request(body, kind, url, KEYS, ("/login",))
    return out["body"] if out["changed"] else None


def test_whole_values_go():
    assert json.loads(request('{"pass":{"a":"secret"},"token":["s1","s2"],"n":1}')) == {"pass": R.MARK, "token": R.MARK, "n": 1}
    assert "secret" not in request(json.dumps({"a": [json.dumps({"b": json.dumps([{"Token": "secret"}])})]}))
    assert request('{"n":"{not json","t":"pass"}') is None and request("[1, 2") is None and request(None) is None
    deep = "[" * 100_000 + '{"pass":"secret"}' + "]" * 100_000
    assert "secret" not in (request(deep) or deep)
    assert request("pass=a%20b&x=%7B%22token%22%3A1%7D&y=") == "pass=%5BREDACTED%5D&x=%7B%22token%22%3A%22%5BREDACTED%5D%22%7D&y="
    assert request("x=1&y=2") is None and request("free text") is None
    assert request("free text", url="https://h/Login/now") == R.MARK and request("x=1", url="https://h/?q=/login") is None


def test_named_patterns_keep_bodies_valid():
    rules = [R.Rule("id", r'"USER"\s*:\s*"(?P<secret>[^"]+)"', "100"), R.query_rule(("ct0",))]
    own = [(r, R.re.compile(r.pattern, r.flags)) for r in rules]
    page = '<script data-content-len="3" id="x">{"USER":"77","é":1}</script><a href="?ct0=z&amp;b=1">getct0=keep</a>'
    out = R.clean_body(page, "text/html", own)
    assert out["body"] == '<script data-content-len="21" id="x">{"USER":"100","é":1}</script><a href="?ct0=[REDACTED]&amp;b=1">getct0=keep</a>' and out["changed"] == ["ct0", "id"]
    assert len('{"USER":"100","é":1}'.encode()) == 21
    for kind in ("application/javascript", "image/png"):
        assert R.clean_body(page, kind, own) == {"body": page, "changed": []}
    assert R.clean_body("plain ct0=1", None, own)["changed"] == [] and R.clean_body("<p>", "", own) == {"body": "<p>", "changed": []}
    with pytest.raises(ValueError, match="x"):
        R.rules_from({"x": {"pattern": "a(b)"}})


def test_requests_as_columns(spark):
    df = spark.createDataFrame([('{"pass":1}', None), (None, None), ("a=1", "u")], "b string, u string")
    got = df.select(R.redacted_requests(("PASS",))(F.col("b"), F.lit(None).cast("string"), F.col("u")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [('{"pass":"[REDACTED]"}', True), (None, False), ("a=1", False)]


def test_failed_replacement_keeps_the_old_state(spark, tmp_path):
    folder = str(tmp_path / "state")
    read = lambda: sorted(r.id for r in state.read(spark, folder, "id long").collect())
    assert read() == []
    state.replace(spark.range(5), folder)
    assert read() == [0, 1, 2, 3, 4]
    fails = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 90, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        state.replace(fails, folder)
    assert read() == [0, 1, 2, 3, 4]
    state.replace(state.read(spark, folder, "id long").where("id > 1"), folder)
    assert read() == [2, 3, 4] and len(list((tmp_path / "state").glob("v-*"))) == 2  # one is the failed job's


def test_links_of_objects_and_parents(spark):
    post = spark.createDataFrame([(1, [("http://t.co/a", "http://real/a"), ("http://t.co/b", None)], [("http://m/1",)])], "post_id long, urls array<struct<url:string,expanded_url:string>>, media_urls array<struct<url:string>>")
    got = D.built(post, D.BY_NAME["x", "post"], "c", F.current_timestamp()).first()
    assert got.links == ["http://real/a", "http://t.co/b"] and got.links_hosts == ["m", "real", "t.co"] and got.evidence == ["https://x.com/i/status/1", "https://twitter.com/i/status/1"]
    comments = spark.createDataFrame([(7, "s"), (8, "t"), (9, None)], "comment_id long, post_shortcode string")
    posts = spark.createDataFrame([("s", "https://i/own/"), ("s", None), ("t", ""), (None, "x")], "shortcode string, permalink_url string")
    joined = D.with_parents(comments, posts, "post_shortcode", "shortcode")
    docs = {r.id: r.url for r in D.built(joined, D.BY_NAME["instagram", "comment"], "c", F.current_timestamp()).collect()}
    assert docs == {"instagram:comment:7": "https://i/own/c/7/", "instagram:comment:8": None, "instagram:comment:9": None}


def test_postcodes_and_roots(spark):
    good = ["M1 1AA", "M60 1NW", "CR2 6XH", "DN55 1PT", "W1A 1HQ", "EC1A 1BB", "sw1a2aa", "gir0aa"]
    bad = ["QA1 1AA", "M1 1AC", "AJ1 1AA", "M1I 1AA", "EC1A 1BB x", "M1", ""]
    rows = spark.createDataFrame([(x,) for x in good + bad], "t string")
    assert [r[0] for r in rows.select(platforms.is_postcode(F.col("t"))).collect()] == [True] * len(good) + [False] * len(bad)
    docs = ["<!DOCTYPE a [ <!ENTITY x 'y>'> <!-- don't ] --> ]><r xmlns='urn:Q'>", "<?xml version='1.0'?><!DOCTYPE a SYSTEM \"x>y\">\n<p:R xmlns:p='U' a='b'/>", "<r>", "text", "<!DOCTYPE a [" + "<!ENTITY x 'y'>" * 5000 + "]><r xmlns='u'>"]
    rows = spark.createDataFrame([(x,) for x in docs], "t string")
    assert [r[0] for r in rows.select(platforms.xml_root(F.col("t"))).collect()] == ["urn:q#r", "u#r", None, None, "u#r"]

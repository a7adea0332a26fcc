"""Vectors of platform functions: one literal input for each case."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from cairn.functions import platforms as P


def got(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = [r[0] for r in rows.select(F.col("i"), fn(F.col("v")).alias("x")).orderBy("i").select("x").collect()]
    return [tuple(x) if hasattr(x, "asDict") else x for x in out]


def test_addresses(spark):
    images = ["https://p/1.JPEG", "https://p/1.png?x=1", "https://p/1.PNG#f", "https://p/1", "https://p/1/page", "https://p/1.svg"]
    assert [(x[0], len(x), x[-1]) for x in got(spark, P.original_image, images)] == [("https://p/1?format=jpg&name=orig", 4, images[0]), ("https://p/1?format=png&name=orig", 4, images[1]), ("https://p/1?format=png&name=orig", 4, images[2]), *[(u, 1, u) for u in images[3:]]]
    targets = [" @u1", "https://Mobile.Twitter.com/someone/status/12?s=20", "#tag1", "https://x.com/search?q=cats%20%26%20x&f=top", "https://x.com/home/", "x.com/u1/with_replies", "https://other/u1", "a b"]
    assert got(spark, P.x_target, targets) == [("profile", "u1"), ("post", "12"), ("search", "#tag1"), ("search", "cats & x"), None, ("profile", "u1"), None, None]
    pages = ["https://f/permalink.php?id=9&story_fbid=1", "https://f/Page/posts/1/?ref=x", "https://f/Page/posts/a-title-1", "https://f/Page", "https://f/groups/club/posts/1", "https://f/watch/?v=1"]
    assert got(spark, P.facebook_target, pages) == [("post", "1"), ("post", "1"), ("post", "a-title-1"), ("page", None), ("page", "1"), ("post", "1")]


def test_payload_values(spark):
    nodes = ['{"runs":[{"text":" a"},{"bold":true},{"text":" b"}]}', '{"simpleText":"x "}', '" plain "', '{"runs":[]}', '{"content":"c"}', '{"simpleText":"  "}']
    assert got(spark, P.text_of, nodes) == ["a b", "x", "plain", None, "c", None]
    b64 = lambda s: base64.b64encode(s.encode()).decode().rstrip("=")
    ids = [b64("comment:999_7"), b64("feedback:12345_77"), b64("S:_I100:VK:7"), b64("profile:123456"), "", "not base64 at all"]
    assert got(spark, P.relay_id, ids) == [("comment", "7"), ("post", "12345"), ("story", "7"), None, None, None]
    objects = ['{"post_id":"7","x":1}', '{"post_id":"","PostID":"7"}', '{"a":{"b":[1,{"legacyPostId":null,"post_ID":7}]}}', '{"a":{"b":{"c":{"postId":"7"}}}}', '{"a":{"b":{"c":{"d":{"post_id":"7"}}}}}', "[]"]
    assert got(spark, lambda v: P.find_value(v, ("post_id",)), objects) == ["7", "7", "7", "7", None, None]
    assert got(spark, lambda v: P.lookup(v, ("post_id",)), objects) == ["7", "7", None, None, None, None]
    media = ['{"image_versions2":{"candidates":[{"url":"i1","width":10},{"url":"i2","width":20},{"url":"i3","width":20},{"width":99}]}}', '{"media_type":2,"video_versions":[{"url":"v1","width":10},{"url":"v2","width":9}]}', '{"video_versions":[{"url":"v9","width":90}],"product_type":"clips"}', '{"display_url":"d"}', "{}", '{"media_type":2}']
    assert got(spark, P.best_rendition, media) == [("image", "i2", 20), ("video", "v1", 10), ("reel", "v9", 90), ("image", "d", None), ("image", None, None), ("video", None, None)]


def test_choices(spark):
    tracks = lambda manual, automatic, own: spark.range(1).select(P.subtitle_tracks(*[F.array(*map(F.lit, x)).cast("array<string>") for x in (manual, automatic)], F.lit(own).cast("string"))).first()[0]
    assert tracks([], ["fr", "a-orig"], "fr") == ["a-orig"] and tracks(["en", "live_chat", "de"], ["fr", "en"], "en") == ["de", "en"] and tracks([], ["fr", "en"], "fr") == ["fr"]
    assert tracks(["en", "live_chat", "de"], ["fr", "en"], "fr") == ["de", "en", "fr"] and tracks([], [], "fr") == [] and tracks(["en", "de"], ["fr", "a-orig"], None) == ["de", "en", "a-orig"]
    assert got(spark, P.yes_or_no, ["1. Yes, it is", "NOT relevant", "maybe yes", "", "no", '"relevant"']) == ["keep", "reject", "unsure", "unsure", "reject", "keep"]
    rows = spark.createDataFrame([(100, None, "20240203", None), (0, 50, None, None), (None, None, "20240203", None), (None, None, "", "20230102"), (None, None, "2024", None), (-5, None, None, None)], "a long, b long, c string, d string")
    assert [r[0] for r in rows.select(P.uploaded_at(*map(F.col, "abcd"))).collect()] == ["1970-01-01T00:01:40Z", "1970-01-01T00:00:50Z", "2024-02-03T00:00:00Z", "2023-01-02T00:00:00Z", None, None]
    header = lambda *pairs: spark.createDataFrame([(list(pairs),)], "h array<struct<name:string,value:string>>").select(P.clean_headers(F.col("h"))).first()[0]
    assert [tuple(x) for x in header(("Set-Cookie", "a\r\nb"), (":status", "200"), ("X-A", "1"))] == [("Set-Cookie", "a, b"), ("X-A", "1")]
    assert [tuple(x) for x in header(("bad name", "lost"), ("CSP", "default x"), ("img src", "y"), ("", "x"), ("Ok", None))] == [("CSP", "default x, img src: y"), ("Ok", "")]
    block = lambda *pairs: spark.createDataFrame([(list(pairs),)], "b array<struct<size:int,hash:string>>").select(P.fuzzy_text(F.col("b"), F.lit("f.html"))).first()[0]
    assert block((96, "a"), (48, "b")) == "48:b:a:f.html" and block((48, "b")) is None and block() is None and block((48, "b"), (96, "a"), (96, "c")) is None

"""Sources, HTML, functions and operators on small made-up inputs."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from cairn.functions import html, texts, times, urls
from cairn.operators import captures, documents, rollups, theme
from cairn.sources import files, warc

PAGE = """<html lang="en"><head><title>News &amp; more</title><meta name="description" content="short"><script>var x = "a<b";</script></head>
<body class="x1"><nav><a href="/home">Home</a></nav><article><h1>Big news</h1><p>Something <b>happened</b> today.</p><a href="/more">more</a><img src="i.png"></article><footer>foot</footer></body></html>"""


def records():
    body = b"<html><body>hello</body></html>"
    digest = "sha1:" + hashlib.sha1(body).hexdigest()
    head = [{"name": "Content-Type", "value": "Text/HTML; charset=utf-8"}]
    one = {"record_type": "response", "record_id": "<urn:1>", "target_uri": "http://a.example/", "warc_date": "2024-01-01T00:00:00Z", "http_status": 200, "http_headers": head, "body": body}
    two = one | {"record_type": "revisit", "record_id": "<urn:2>", "payload_digest": digest, "refers_to_id": "<urn:1>"}
    lost = two | {"record_id": "<urn:3>", "refers_to_id": "<urn:9>"}
    info = {"record_type": "warcinfo", "record_id": "<urn:0>", "warc_date": "2024-01-01T00:00:00Z", "content_type": "application/warc-fields", "body": b"software: x\r\n"}
    empty = one | {"record_id": "<urn:4>", "target_uri": "http://a.example/api", "body": b"", "http_status": 404}
    return [info, one, two, lost, empty]


def test_warc_round_trip(spark, tmp_path):
    data = b"".join(map(warc.record_bytes, records()))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(data)
    (tmp_path / "in" / "b.warc").write_bytes(gzip.decompress(data))
    (tmp_path / "in" / "broken.warc.gz").write_bytes(data[:-20])
    rows = warc.read(spark, str(tmp_path / "in")).cache()
    counts = {r.warc_file: (r.n, r.bad) for r in rows.groupBy("warc_file").agg(F.count("*").alias("n"), F.count("error").alias("bad")).collect()}
    assert counts == {"a.warc.gz": (5, 0), "b.warc": (5, 0), "broken.warc.gz": (5, 1)}
    got = {(r.warc_file, r.record_id): r for r in warc.captures(rows).where("warc_file <> 'broken.warc.gz'").collect()}
    one = got["a.warc.gz", "<urn:1>"]
    assert (one.status, one.mime, one.hash_matched, one.length, one.orphaned) == (200, "text/html", True, 31, False)
    assert not got["b.warc", "<urn:2>"].orphaned and got["b.warc", "<urn:3>"].orphaned and got["a.warc.gz", "<urn:4>"].status == 404
    for r in rows.where("warc_file = 'a.warc.gz'").collect():
        assert next(iter(warc.members(data[r.record_offset :])))[1].startswith(b"WARC/1.1")
    spark.dataSource.register(warc.WarcSink)
    (tmp_path / "out").mkdir()
    rows.where("warc_file = 'a.warc.gz'").drop("error").withColumn("error", F.lit(None).cast("string")).coalesce(1).write.format("warc_out").option("max_bytes", 600).mode("append").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) > 1
    again = warc.read(spark, str(tmp_path / "out"), bodies=False, types=("response",))
    assert sorted(r.record_id for r in again.collect()) == ["<urn:1>", "<urn:4>"]
    assert warc.extracted(rows, 20).count() < rows.count()


def test_chunked_bodies():
    assert warc.dechunked(b"4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\n\r\n") == b"Wikipedia"
    assert warc.dechunked(b"plain") == b"plain"


def test_pages():
    base = html.fingerprint(PAGE)
    assert base == html.fingerprint(PAGE.replace("x1", "x2").replace("var x", "var  yy").replace("<p>", "<!-- 12 --><p>"))
    assert base != html.fingerprint(PAGE.replace("/more", "/less")) != html.fingerprint(PAGE.replace("today", "now"))
    page = html.page_text(PAGE)
    assert page["title"] == "News & more" and page["headline"] == "Big news" and page["lang"] == "en" and page["description"] == "short"
    assert "foot" not in page["text"] and "happened" in page["text"]
    assert html.feature_lists(PAGE)["links"] == ["/home", "/more"] and html.feature_lists(PAGE)["images"] == ["i.png"]
    assert html.page_text("") == {"title": "", "headline": "", "description": "", "section": "", "tags": [], "keywords": "", "published": None, "lang": "", "main_found": False, "text": ""}
    # Build numbers in style and script addresses, labels of links, and links themselves
    styled = PAGE.replace("</head>", '<link rel="stylesheet" href="/s.css?v=1"><script src="/a.1.js"></script></head>')
    assert html.fingerprint(styled) == html.fingerprint(styled.replace("v=1", "v=2").replace("a.1", "a.2")) == base
    assert base != html.fingerprint(PAGE.replace(">more<", ">much more<")) and base == html.fingerprint(PAGE.replace("<p>", "<p  >\n  "))
    assert html.decoded("é".encode("latin-1"), "iso-8859-1") == "é" and html.decoded("é".encode(), "none") == "é"


def test_page_regions():
    text = lambda body: html.page_text(f"<html><body>{body}</body></html>")["text"]
    assert text("<p>own</p><iframe>frame</iframe><div role='banner'>top</div>") == "own"
    assert text("<nav>menu<p>lost, as the menu isn't closed") == "" and text("<nav>menu</nav><p>kept") == "kept"
    assert text("<article>in<nav>inner menu</nav></article>out") == "ininner menu"  # a main part of a third of the text is enough
    page = html.page_text("<head><meta property='article:tag' content=' a '><meta name='keywords' content='k'><script type='application/ld+json'>[{'x'}]</script><script type='application/ld+json'>{\"@graph\": [{\"headline\": \"h\", \"keywords\": [\"p\", 2], \"about\": [{\"name\": \"n\"}, \"m\"], \"inLanguage\": \"DE-at\"}]}</script></head><time datetime='x'></time><time datetime='2024-02-03 04:05'></time>")
    assert page["headline"] == "h" and page["tags"] == ["a"] and page["keywords"] == "k, p, 2, n, m" and page["lang"] == "de" and page["published"] == "2024-02-03T04:05:00Z"
    assert html.page_text("<p>" + "x" * 100, 10)["text"] == "x" * 10


def test_page_spans():
    """An end tag ends its own element only, and a role ends with the element that has it."""
    text = lambda body: html.page_text(f"<html><body>{body}</body></html>")["text"]
    assert text("</nav><p>a</p></header>") == "a" and text("<div role='banner'>top</div><p>own</p>") == "own"
    assert text("<nav><nav>x</nav>y</nav>z") == "z" and text("<div role='main'>m</div><aside>n</aside>") == "m"
    assert html.page_text("<title>a</title><h1>b <i>c</i></h1><svg><title>d</title></svg>")["headline"] == "b c"
    assert html.iso_date(" 2024-01-02T03:04:05+02:00") == "2024-01-02T03:04:05Z" and html.iso_date("2024-01-02 03:04") == "2024-01-02T03:04:00Z" and html.iso_date("2024-01-02x") == "2024-01-02T00:00:00Z" and html.iso_date("2.1.2024") is None
    found = html.feature_lists("<body background='b.png'><p> <br></p><p>one<p>two</p><a rel='LICENSE' href=' /l '>x</a><table background='t.png'><source srcset='no.png'><picture><source srcset='p1.png 1x, p2.png 2x,'></picture><img srcset='a,b.png' src='c.png'><o:p>y</o:p>")
    assert found["first_paragraph"] == "one" and found["licenses"] == ["/l"] and found["images"] == ["b.png", "t.png", "c.png", "p1.png", "p2.png", "a,b.png"] and "o:p" not in found["elements"]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_url_vectors(spark):
    u = F.lit
    r = one(spark, a=urls.url_key(u("HTTP://A.Example:80/x?b=2&utm_source=y&a=1#f")), b=urls.url_key(u("http://h:443/")), c=urls.normalised(u("https://www2.a.example/p/?z=1&a")), d=urls.registrable(u("x.y.co.uk")), e=urls.url_key(u("not a url ")), f=urls.extension(u("http://h/a/b.JPG?x")), g=urls.normalised(u("http://h:80abc/")))
    assert tuple(r) == ("http://a.example/x?a=1&b=2", "http://h:443/", "http://a.example/p?a=&z=1", "y.co.uk", "not a url", "jpg", "http://h:80abc/")
    assert urls.seed_prefix("http://h/a/b.html") == "http://h/a/" and urls.seed_prefix("http://h/a") == "http://h/a/"
    with pytest.raises(ValueError):
        urls.in_scope(F.lit("x"), "http://h/", "odd")


def test_time_vectors(spark):
    r = one(spark, a=times.parse_time(F.lit("20240229")), b=times.parse_time(F.lit("20241399000000")), c=times.parse_time(F.lit("2024-01-02T03:04:05+02:00")), d=times.relative(F.lit("2 months ago"), F.timestamp_seconds(F.lit(10_000_000))), e=times.loose_date(F.lit("12/25/2020")), f=times.year_of(F.lit("0000")))
    assert str(r.a) == "2024-02-29 00:00:00" and r.b is None and str(r.c) == "2024-01-02 01:04:05" and r.d.timestamp() == 10_000_000 - 2 * 30 * 86400 and str(r.e) == "2020-12-25" and r.f == "unknown"
    assert times.day_bounds("2024-01-01", None) == ("2024-01-01T00:00:00Z", None)


def test_text_vectors(spark):
    r = one(spark, a=texts.parse_count(F.lit("1.29K")), b=texts.parse_count(F.lit("x")), c=texts.base32(F.sha1(F.lit("a"))), d=texts.degrees(F.lit("10°30'S"), 90), e=texts.degrees(F.lit("100°N"), 90), f=texts.charset(F.lit('text/html; charset="UTF-8"')), g=texts.comment_parts(F.lit("a.b")), h=texts.widest(F.array(F.struct(F.lit(1).alias("width"), F.lit("x").alias("u")), F.struct(F.lit(3).alias("width"), F.lit("y").alias("u")))))
    assert r.a == 1290 and r.b is None and r.c == warc.base32_digest(hashlib.sha1(b"a").hexdigest()) and r.d == -10.5 and r.e is None and r.f == "utf-8" and tuple(r.g) == ("a", "b") and r.h.u == "y"


def test_change_classes(spark):
    rows = [(1, 1, "p", "x", 10, 200), (2, 2, "p", "x", 20, 200), (3, 3, "p", "y", 30, 200), (4, 4, "p", "", 40, 404), (5, 4, "q", "", 41, 404), (6, 5, "p", "z", 50, 200), (7, 5, "q", None, 51, 200)]
    pages = spark.createDataFrame(rows, "id long, crawl_id long, url_key string, digest string, seen_at long, status int")
    got = {r.id: (r.change, r.previous_job) for r in captures.classified(pages).collect()}
    assert got == {1: ("new", None), 2: ("unchanged", 1), 3: ("changed", 2), 4: ("gone", 3), 5: (None, None), 6: ("new", 4), 7: (None, 4)}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "a long").collect()) == [1, 2]
    assert files.decode_documents('for(;;);{"a":1}{"b":[2]}\nbroken {\n{"c":3}') == ['{"a": 1}', '{"b": [2]}', '{"c": 3}']
    assert files.decode_documents(None) == []
    df = spark.createDataFrame([(1, '{"x":1}{"y":2}'), (2, None)], "id long, raw string")
    assert [(r.id, r.json) for r in files.json_documents(df, "raw").collect()] == [(1, '{"x": 1}'), (1, '{"y": 2}')]
    (tmp_path / "m.csv").write_text("seed_url,Title,Subject,Subject\n*,Job,,\nhttp://a/,One,s1,s2\n")
    got = [(r.seed, r.name, r.value) for r in files.metadata_sheet(spark, str(tmp_path / "m.csv")).orderBy("seed", "pos").collect()]
    assert got == [(None, "Title", "Job"), ("http://a/", "Title", "One"), ("http://a/", "Subject", "s1"), ("http://a/", "Subject", "s2")]
    sums = files.checksums(spark, str(tmp_path)).collect()
    assert [r.name for r in sums] == ["a.jsonl", "m.csv"] and sums[0].line.startswith(hashlib.sha256((tmp_path / "a.jsonl").read_bytes()).hexdigest())
    page = spark.createDataFrame([('<script type="application/json">{"k": 1}</script><script>var D = {"z": 2};</script>',)], "html string")
    r = page.select(files.embedded_json(F.col("html")).alias("e"), files.assigned_json(F.col("html"), "var D").alias("d")).first()
    assert r.e == ['{"k": 1}'] and r.d == '{"z": 2}'
    out = files.csv_ready(spark.createDataFrame([(1, ["a", "b"])], "id long, tags array<string>"), ["id", "tags", "none"]).first()
    assert tuple(out) == ("1", '["a","b"]', None)


def test_frontier(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    keep = lambda df: df.checkpoint()
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = [(r.url, r.depth) for r in documents.frontier(seeds, edges, 2, 10, keep).collect()]
    assert got == [("a", 0), ("b", 1), ("c", 2)]


def test_theme_rules(spark):
    t = theme.Theme(terms=("library", "book"), min_score=4, url_exclude=("/x/",))
    cols = dict(u=F.lit("http://h/"), h=theme.read(t, F.lit("the libraries of the town")), m=theme.read(t, F.lit("")), b=theme.read(t, F.lit("a book, two books and bookings. book book")))
    r = one(spark, s=theme.scores(t, cols["u"], cols["h"], cols["m"], cols["b"]), x=theme.hard_reason(t, F.lit("http://h/x/"), F.lit(None).cast("string"), cols["h"], cols["b"]))
    assert tuple(r.s) == (3, 0, 3, 6) and r.x == "url"
    assert len(t.fingerprint()) == 16 and t.fingerprint() != theme.Theme().fingerprint()


def test_reconciled(spark):
    jobs = spark.createDataFrame([(1, "running", False, 0), (2, "stopping", False, 0), (3, "running", True, 0), (4, "running", False, 990)], "job long, status string, alive boolean, updated long")
    assert [r.new_status for r in rollups.reconciled(jobs, F.lit(1000)).orderBy("job").collect()] == ["failed", "stopped", "running", "running"]


def test_identities_of_chains(spark):
    from cairn.operators import graph

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (45, 50)], "a long, b long")
    got = {r.id: r.root for r in graph.identities(edges, lambda df: df.checkpoint()).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 45: 40, 50: 40}


def test_payload_walk(spark):
    from cairn.operators import social_json

    payload = '{"a": {"type": "x", "b": [{"id": "1", "text": "t"}, {"id": "1", "text": "t", "like_count": 3}]}, "end_cursor": "c"}'
    assert [p for p, _, _, _ in social_json.walk(payload)] == ["", "a", "a.b.0", "a.b.1"]
    assert list(social_json.walk(None)) == [] == list(social_json.walk("{broken"))
    assert [cut for *_, cut in social_json.walk(payload, 2)] == [False, True]
    found = social_json.nodes(spark.createDataFrame([(7, payload), (8, None)], "id long, raw string"), "raw").cache()
    assert {(r.post_id, r.text, r.likes) for r in social_json.posts(found).collect()} == {("1", "t", 3)}
    assert [r.token for r in social_json.continuation_tokens(found).collect()] == ["c"]


def test_mapping_choices(spark):
    from cairn.operators import mapping

    assert mapping.deep_merged({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": 4}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": 4}
    rules = spark.createDataFrame([("http://h", False, "/a"), ("http://h", True, "/a/b"), ("http://h", False, "/c"), ("http://h", True, "/c")], "origin string, allow boolean, prefix string")
    pages = spark.createDataFrame([("http://h/a/x",), ("http://h/a/b/x",), ("http://h/c",), ("http://other/a",), ("http://h/",)], "url string")
    assert {r.url: r.allowed for r in mapping.robots_allowed(pages, rules).collect()} == {"http://h/a/x": False, "http://h/a/b/x": True, "http://h/c": True, "http://other/a": True, "http://h/": True}


def test_seeds_of_a_configuration(spark):
    config = '{"defaults": {"scope": {"kind": "host", "depth": 2}}, "seeds": ["http://a/", {"url": "http://b/", "scope": {"depth": 5}}]}'
    rows = files.crawl_config(spark, config, "url string, scope struct<kind:string,depth:int>").collect()
    assert [(r.url, r.scope.kind, r.scope.depth) for r in rows] == [("http://a/", "host", 2), ("http://b/", "host", 5)]
    with pytest.raises(ValueError):
        files.crawl_config(spark, {"defaults": {}}, "url string")


def test_arc_and_encoded_records():
    import zlib

    body = b"<html>x</html>"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: %s\r\n\r\n"
    arc = b"filedesc://a.arc 0.0.0.0 20240102030405 text/plain 3\nabc\n"
    for name, data in ((b"gzip", gzip.compress(body)), (b"deflate", zlib.compress(body)), (b"deflate", zlib.compressobj(wbits=-15).compress(body)), (b"odd", body)):
        if name == b"deflate" and data == b"":
            c = zlib.compressobj(wbits=-15)
            data = c.compress(body) + c.flush()
        part = block % name + data
        arc += b"http://a/ 1.2.3.4 20240102030405 text/html %d\n" % len(part) + part + b"\n"
    got = list(warc.records(arc))
    assert [r["record_type"] for r in got] == ["warcinfo", "arc", "arc", "arc", "arc"] and got[1]["warc_date"] == "2024-01-02T03:04:05Z"
    assert all(r["body"] == body and r["http_status"] == 200 for r in got[1:])
    assert [r["body"] for r in warc.records(gzip.compress(arc))] == [r["body"] for r in got]
    assert next(iter(warc.records(arc, inflate=False)))["body"] == b"abc"
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    one = warc.record_bytes({"record_type": "response", "target_uri": "http://a/", "warc_date": "x", "http_headers": [], "body": body, "payload_digest": "sha1:" + sha})
    assert [r["hash_matched"] for r in warc.records(one + b"\0\0" + one)] == [True, True] and warc.unpacked(b"no", "gzip") == b"no"
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.records(one + one[:-5]))
    many = b"".join(warc.record_bytes({"record_type": "resource", "target_uri": "u", "warc_date": "x", "body": bytes([i % 256]) * 3000}) for i in range(2000))
    assert sum(1 for _ in warc.records(memoryview(many))) == 2000


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_nearest_against_all_pairs(spark, width):
    import random

    rng = random.Random(width)
    recs = [(rng.choice("abc"), i, rng.randrange(60), rng.random() < 0.3) for i in range(80)]
    asked = [(rng.choice("abcd"), i, rng.randrange(60)) for i in range(50)]
    records = spark.createDataFrame(recs, "k string, rec long, seen long, rank boolean")
    rows = spark.createDataFrame(asked, "k string, id long, seen long")
    got = {r.id: r.record and r.record.rec for r in documents.nearest(rows, records, "k", "seen", ["rank"], width).collect()}
    want = {i: max(((-r[3], -abs(r[2] - at), -r[2], r[1]) for r in recs if r[0] == k), default=(None,))[-1] for k, i, at in asked}
    assert got == want


def test_language_and_first_rows(spark):
    from cairn.operators import timeline

    docs = spark.createDataFrame([(1, "en", "the cat the"), (2, "de", "der hund"), (3, "en", None), (4, "de", "zzz qqq"), (5, None, "the der der")], "doc_id long, lang string, text string")
    train = docs.where("doc_id < 3")
    profiles = documents.word_profiles(train, "lang")
    for most in (1000, 1):  # sets, and a join
        assert {r.doc_id: r.guess for r in documents.language(docs, profiles, most=most).collect()} == {1: "en", 2: "de", 3: None, 4: None, 5: "de"}
    rows = spark.createDataFrame([("k", i) for i in range(500)] + [("l", 3)], "k string, i long")
    assert sorted((r.k, r.i) for r in timeline.first_rows(rows, "k", ["i"], 3, parts=5).collect()) == [("k", 0), ("k", 1), ("k", 2), ("l", 3)]
    posts = spark.createDataFrame([("a", 2, None, ["y", "x"]), ("a", 1, "v", ["x"]), ("a", 3, "w", None), ("b", 4, None, None)], "k string, id long, f string, l array<string>")
    got = {r.k: (r.f, r.l) for r in timeline.merged_by_alias(posts, "k", "id", ["f"], [], [], ["l"], 2).collect()}
    assert got == {"a": ("v", ["x", "y"]), "b": (None, [])}


def test_hidden_fields(spark):
    from cairn.functions import platforms

    node = F.lit('{"a": {"legacyPostId": null}, "list": [1, {"Post_Id": 7}], "deep": {"b": {"c": {"post_id": "x"}}}}')
    r = one(spark, found=platforms.find_value(node, ("post_id",)), none=platforms.find_value(F.lit("[1]"), ("x",)), t=platforms.x_target(F.lit("search:  ")), u=platforms.x_target(F.lit("https://x.com/i/status/12")), relay=platforms.relay_id(F.lit("bm90IGEgcmVsYXkgaWQ")))
    assert r.found == "7" and r.none is None and r.t is None and tuple(r.u) == ("post", "12") and r.relay is None

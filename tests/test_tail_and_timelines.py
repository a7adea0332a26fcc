"""Growing files, and timelines that payloads build up."""

from __future__ import annotations

import io
import json
import random

import pytest

from cairn.operators import payload_timeline as L
from cairn.streaming import tail


@pytest.mark.parametrize("split", [1, 3, 7, 64, 10_000])
def test_ranges_give_each_line_once(split):
    rng = random.Random(1)
    data = "\n".join("x" * rng.choice([0, 0, 1, 5, 40]) for _ in range(60)).encode() + b"\nrest"
    stream = io.BytesIO(data)
    end = tail.last_line_end(stream, 0, len(data))
    assert data[end:] == b"rest" and tail.last_line_end(stream, end, len(data)) == end
    begin = data.index(b"\n") + 1
    got = [x for a in range(begin, end, split) for x in tail.lines(stream, a, min(a + split, end), end, begin)]
    assert [x for _, x in got] == data[begin:end].split(b"\n")[:-1] and all(data[p : p + len(x)] == x for p, x in got)


def test_half_a_line_is_held_back(spark, tmp_path):
    log, folder = tmp_path / "in" / "a.log", tmp_path / "out"
    log.parent.mkdir()

    def run() -> list[str]:
        stream = tail.tailed(spark, str(log.parent), "*.log", split=5)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(folder / "c")).start(str(folder / "rows"))
        query.processAllAvailable()
        query.stop()
        return [r.line for r in spark.read.schema(tail.SCHEMA).parquet(str(folder / "rows")).orderBy("path", "position").collect()]

    log.write_bytes(b"one\ntwo\nthr")
    (log.parent / "b.txt").write_bytes(b"other\n")
    assert run() == ["one", "two"]
    with log.open("ab") as f:
        f.write(b"ee\r\n\nfo")
    assert run() == ["one", "two", "three", ""]
    with log.open("ab") as f:
        f.write(b"ur and more\n")
    (log.parent / "c.log").write_bytes(b"new\n")
    assert run() == ["one", "two", "three", "", "four and more", "new"]
    assert run() == ["one", "two", "three", "", "four and more", "new"]


def test_a_shorter_file_is_read_again():
    reader = tail._Reader({"path": "/x"})
    new = {"files": json.dumps({"/x/a": 10, "/x/b": 5})}
    parts = reader.partitions({"files": json.dumps({"/x/a": 4, "/x/b": 50})}, new)
    assert [(p.path, p.first, p.last) for p in parts] == [("/x/a", 4, 10), ("/x/b", 0, 5)]


def entry(post: str, text: str | None, **more) -> dict:
    result = {"rest_id": post, "legacy": {"full_text": text, "reply_count": 1} if text else {}} | more
    return {"entryId": f"tweet-{post}", "content": {"itemContent": {"itemType": "TimelineTweet", "tweet_results": {"result": result}}}}


def test_operations_and_posts(spark):
    wrapped = {"entryId": "tweet-9", "content": {"itemContent": {"itemType": "TimelineTweet", "tweet_results": {"result": {"__typename": "TweetWithVisibilityResults", "tweet": {"rest_id": "9", "legacy": {"full_text": "nine"}}}}}}}
    gone = {"entryId": "tweet-8", "content": {"itemContent": {"itemType": "TimelineTweet", "tweet_results": {"result": {"__typename": "TweetUnavailable", "reason": "Suspended"}}}}}
    one = {"a": [{"instructions": [{"type": "TimelineAddEntries", "entries": [entry("1", "short"), entry("2", "two"), wrapped, gone, "odd", {"entryId": "cursor-x", "content": {"itemContent": {"itemType": "TimelineTimelineCursor", "value": "v1"}}}]}, {"type": "TimelinePinEntry", "entry": entry("1", "short")}, {"type": "Other"}]}], "instructions": ["not typed"]}
    two = {"instructions": [{"type": "TimelineReplaceEntry", "entry": entry("1", "a longer text")}, {"type": "TimelineAddEntries", "entries": [entry("2", None), {"entryId": "cursor-y", "content": {"cursorType": "Bottom", "value": "v2", "stopOnEmptyResponse": True}}]}, {"type": "TimelineTerminateTimeline", "direction": "Top"}]}
    rows = spark.createDataFrame([("t", 0, json.dumps(one)), ("t", 1, json.dumps(two)), ("u", 0, "not json"), ("u", 1, None)], "k string, nr int, payload string")
    ops = L.operations(rows, "payload", "nr").cache()
    posts = {r.post_id: r for r in L.posts(ops, "k").collect()}
    assert {p: (r.text, r.pinned, r.op) for p, r in posts.items()} == {"1": ("a longer text", True, "replace"), "2": ("two", False, "add"), "9": ("nine", False, "add")}
    assert [tuple(r) for r in L.absences(ops, "k").collect()] == [("t", "tweet-8", "8", "unavailable", "Suspended")]
    assert [tuple(r) for r in L.cursors(ops, "k").collect()] == [("t", "Bottom", "v2", True)]
    assert L.pages_left(ops, "k").count() == 1 and L.pages_left(ops, "k", "Top").count() == 0
    assert {r.entry_id: (r.op, r.pinned) for r in L.entries(ops, "k").collect()} == {"tweet-1": ("replace", True), "tweet-2": ("add", False), "tweet-9": ("add", False), "tweet-8": ("add", False)}
    assert [r.ended for r in L.summary(ops, "k").collect()] == [["Top"]]
    assert not any(r.cut for r in ops.select("cut").collect())
    cut = L.operations(rows, "payload", "nr", budget=3)
    assert cut.where("cut").count() >= 1

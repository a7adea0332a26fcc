"""Objects of payloads: chosen fields, the id above, and addresses of media in order."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cairn.operators import indexing as I
from cairn.operators import social_json as J


def payloads(spark, *values):
    return spark.createDataFrame([(i, v if v is None else json.dumps(v)) for i, v in enumerate(values)], "k long, body string")


def test_only_objects_with_the_fields(spark):
    rows = payloads(spark, {"id": 1, "x": [{"cid": "a", "n": {"y": 1}}, {"b": {"id": None}}]}, None, {"é": {"cid": "\ud800"}}, [])
    found = J.nodes(rows, "body", fields=("cid", "id"))
    assert [(r.k, r.path, json.loads(r.node), r.at) for r in found.collect()] == [(0, "", {"id": 1}, 0), (0, "x.0", {"cid": "a"}, 1), (0, "x.1.b", {"id": None}, 4), (2, "é", {"cid": "\ud800"}, 1)]


def test_the_id_above(spark):
    rows = payloads(spark, {"cid": "top", "r": [{"cid": "a", "x": {"id": None, "r": {"cid": "b"}}}, {"id": 7, "cid": None, "r": {"cid": "c"}}]})
    found = J.nodes(rows, "body", fields=("cid",), ids=("cid", "id"))
    got = I.nearest_ancestor(found, "k", F.get_json_object("node", "$.cid").isNotNull()).collect()
    assert {(r.path, r.parent) for r in got} == {("", None), ("r.0", "top"), ("r.0.x.r", "a"), ("r.1.r", "7")}


def test_many_nodes_go_on_in_parts(spark, monkeypatch):
    rows = payloads(spark, *[[{"id": f"{i}-{j}"} for j in range(300)] for i in range(3)]).coalesce(1)
    monkeypatch.setattr(J, "CHARS", 1000)
    assert {(r.k, r.id) for r in J.nodes(rows, "body").select("k", F.get_json_object("node", "$.id").alias("id")).collect()} == {(i, f"{i}-{j}") for i in range(3) for j in range(300)}


def test_media_in_order_and_up_to_most(spark):
    rows = payloads(spark, {"image": [{"src": f"http://m/{i % 7}", "uri": "http://u"} for i in range(20)]}, {"other": {"src": "http://no"}})
    found = J.nodes(rows, "body", fields=("src", "uri"))
    assert [(r.k, r.urls) for r in I.media_urls(found, "k", ("src", "uri"), ("image",), 4).collect()] == [(0, ["http://m/0", "http://u", "http://m/1", "http://m/2"])]

"""Identities over every event against a brute-force union."""

from __future__ import annotations

import json

from cairn import registry


def test_every_event_links(spark, tmp_path):
    edges = [(1, 1, "view", 3.0), (2, 1, "click", 50.0), (2, 2, "purchase", 1.0), (3, 3, "purchase", 90.0), (4, 3, "error", 2.0), (5, 9, "view", 0.0)]
    rows = [(u, kind, v, json.dumps({"k": k})) for u, k, kind, v in edges]
    spark.createDataFrame(rows, "user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    root = {x: x for u, k, *_ in edges for x in (u, 100000 + k)}
    for _ in edges:
        for u, k, *_ in edges:
            root[u] = root[100000 + k] = min(root[u], root[100000 + k])
    got = {r.id: r.root for r in registry.queries()["j14_alias_identity_all"](spark, str(tmp_path)).collect()}
    assert got == root

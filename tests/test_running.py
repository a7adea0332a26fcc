"""Running values over ranges against loops over whole keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import indexing, rollups, running, timeline


@pytest.fixture(scope="module")
def many(spark):
    """A key with most rows, small ones and a null one, over more ranges than a session has by default."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 8 + ["b", None]), rng.choice([True, True, False, None]), rng.random() < 0.05, rng.choice([1, 2, 7, None]), rng.randrange(4000)) for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark.createDataFrame(rows, "id long, target string, hit boolean, reset boolean, n int, at long").repartition(5), rows
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sums_and_runs(many):
    df, rows = many
    want_sum, want_run, sums, runs = {}, {}, {}, {}
    for i, key, hit, reset, n, _ in rows:
        sums[key] = want_sum[i] = sums.get(key, 0) + (n or 0)
        runs[key] = want_run[i] = 0 if reset and not hit else (0 if reset else runs.get(key, 0)) + bool(hit) if not (reset and hit) else 0
    got = {r.id: r.s for r in running.running_sum(df, "target", ["id"], F.col("n"), "s").collect()}
    assert got == want_sum
    got = {r.id: r.run for r in timeline.run_lengths(df, ["id"], F.col("hit"), F.col("reset")).collect()}
    assert got == want_run
    most = 9
    first = {}
    for i, key, *_ in rows:
        if want_run[i] >= most:
            first.setdefault(key, i)
    kept = {(r.id, r.stop) for r in timeline.until_run(df, ["id"], F.col("hit"), F.col("reset"), most).collect()}
    assert kept == {(i, first.get(key) == i) for i, key, *_ in rows if i <= first.get(key, 10**9)} and first


def test_earlier_and_recent(many):
    df, rows = many
    got = {r.id: r.later for r in rollups.later_siblings(df, "target", "id", "at").collect()}
    assert got == {i: sum(1 for r in rows if r[1] == key and r[5] >= at) - 1 for i, key, *_, at in rows}
    got = {r.id: r.used for r in timeline.sliding_sum(df.withColumn("at", F.when(F.col("id") != 7, F.col("at"))), F.col("at"), F.col("n"), 50, "target").collect()}
    want = {}
    for i, key, _, _, _, at in rows:
        near = [r[4] for r in rows if r[1] == key and r[0] != 7 and at - 50 <= r[5] <= at and r[4] is not None]
        want[i] = sum(near) if near and i != 7 else None
    assert got == want
    first = {(r.target, r.id) for r in timeline.first_of(df, ["target"], ["at", "id"], 3).collect()}
    assert first == {(key, r[0]) for key in ("hot", "b", None) for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[5], r[0]))[:3]}


def test_chunks_of_long_pages(spark):
    rng = random.Random(4)
    costs = [rng.choice([5, 30, 80, 300]) for _ in range(3000)]
    want, used, chunk = {}, 0, -1
    for i, c in enumerate(costs):
        if chunk < 0 or used + c > 200 - 20:
            used, chunk = 0, chunk + 1
        used += c
        want[i] = chunk
    links = spark.createDataFrame([("p", i, c) for i, c in enumerate(costs)] + [("q", 0, 1000)], "page string, i int, cost int")
    got = indexing.link_chunks(links, "page", "i", "cost", 20, 200).collect()
    assert {r.i: r.chunk for r in got if r.page == "p"} == want and [r.chunk for r in got if r.page == "q"] == [0]

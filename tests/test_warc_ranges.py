"""WARC files read in ranges, by heads, again after a failure, and one record at a time."""

from __future__ import annotations

import gzip
import io
import os
import time
import tracemalloc

from pyspark.sql import functions as F

from cairn.sources import warc


def resource(i: int, body: bytes, kind: str = "response") -> bytes:
    return warc.record_bytes({"record_type": kind, "record_id": f"<urn:{i}>", "target_uri": f"http://h/{i}", "warc_date": "2024-01-01T00:00:00Z", "http_status": 200, "http_headers": [], "body": body})


def big_file(n: int = 400, size: int = 20_000) -> tuple[bytes, list[bytes]]:
    nested = b"".join(resource(1000 + i, os.urandom(50)) for i in range(20))  # a WARC inside a record looks like members
    bodies = [nested * 3 if i % 50 == 7 else os.urandom(size) for i in range(n)]
    return b"".join(resource(i, b) for i, b in enumerate(bodies)), bodies


def test_ranges_give_all_records_once(spark, tmp_path):
    data, bodies = big_file()
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(gzip.decompress(data))
    want = {(f, f"<urn:{i}>", len(b)) for f in ("a.warc.gz", "b.warc") for i, b in enumerate(bodies)}
    rows = warc.read(spark, str(tmp_path), split=1 << 20)
    got = rows.select("warc_file", "record_id", F.length("body"), "hash_matched", F.spark_partition_id()).collect()
    assert {tuple(r)[:3] for r in got} == want and len(got) == len(want) and all(r.hash_matched for r in got)
    assert len({r[4] for r in got}) >= 8
    whole = warc.read(spark, str(tmp_path)).select("record_id", "record_offset", "warc_file").collect()
    assert set(whole) == set(rows.select("record_id", "record_offset", "warc_file").collect())
    heads = warc.response_heads(spark, str(tmp_path)).where("warc_file = 'a.warc.gz'").collect()
    assert {h.target_uri for h in heads} == {f"http://h/{i}" for i in range(len(bodies))}
    places = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), h.record_offset) for h in heads if h.target_uri in ("http://h/7", "http://h/399")], "path string, record_offset long")
    assert {r.record_id: bytes(r.body) for r in warc.fetched(places).collect()} == {"<urn:7>": bodies[7], "<urn:399>": bodies[399]}


def test_a_broken_record_keeps_what_stands_before(spark, tmp_path):
    data, bodies = big_file(100)
    at = [o for o, _ in warc.members(data)]
    broken = bytearray(data)
    broken[at[40] + 2000 : at[40] + 2200] = bytes(200)
    (tmp_path / "a.warc.gz").write_bytes(broken)
    rows = warc.read(spark, str(tmp_path), split=1 << 18).collect()
    errors = [r for r in rows if r.error]
    found = {r.record_id for r in rows if not r.error}
    assert len(errors) == 1 and {f"<urn:{i}>" for i in range(40)} <= found and len(found) == len(rows) - 1


class Flaky(io.BytesIO):
    """Fails once when it is read behind an offset."""

    left = 1

    def read(self, n=-1):
        if self.tell() > 300_000 and Flaky.left:
            Flaky.left -= 1
            raise OSError("connection lost")
        return super().read(n)


def test_a_failed_read_is_tried_once_more():
    data, bodies = big_file(100)
    for times, errors in ((1, 0), (2, 1)):
        Flaky.left = times
        rows = list(warc.retried(lambda: Flaky(data), 0, None, True, False))
        assert sum(1 for r in rows if r["error"]) == errors
        ids = [r["record_id"] for r in rows if not r["error"]]
        assert len(ids) == len(set(ids)) and (errors or len(ids) == 100)


def test_heads_are_cheap_and_memory_is_flat():
    """A record of 200 MB that deflates well is gone over without being held; heads cost less than bodies and digests."""
    data = resource(0, b"x") + resource(1, bytes(200 << 20)) + resource(2, b"y")
    tracemalloc.start()
    rows = list(warc.streamed(io.BytesIO(data), light=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["record_id"] for r in rows] == ["<urn:0>", "<urn:1>", "<urn:2>"] and rows[1]["http_status"] == 200 and peak < 16 << 20
    plain, _ = big_file(300)
    took = {}
    for light in (True, False):
        began = time.perf_counter()
        assert sum(1 for _ in warc.streamed(io.BytesIO(plain), light=light)) == 300
        took[light] = time.perf_counter() - began
    assert took[True] < took[False]


def test_records_behind_each_other_in_one_member():
    one = gzip.decompress(resource(1, b"a" * 1000)) + gzip.decompress(resource(2, b"b" * 1000))
    rows = list(warc.records(gzip.compress(one)))
    assert [(r["record_id"], r["record_offset"], len(r["body"])) for r in rows] == [("<urn:1>", 0, 1000), ("<urn:2>", 0, 1000)]
    assert list(warc.records(b"")) == []

"""Documents written to files: whole batches, nothing of a failed job, a replayed batch once."""

from __future__ import annotations

import gzip
import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cairn.sources import documents_out as O


def test_batches_by_rows_and_bytes():
    sent = []
    batch = O.Batcher(sent.append, most_rows=3, most_bytes=10)
    for doc in (b"aaaa", b"bbbb", b"cccc", b"d", b"e", b"f", b"x" * 50, b"g"):
        batch.add(doc)
    batch.flush()
    batch.flush()
    assert sent == [[b"aaaa", b"bbbb"], [b"cccc", b"d", b"e"], [b"f"], [b"x" * 50], [b"g"]]


def test_files_of_sources(spark, tmp_path):
    docs = spark.range(200).select(F.concat(F.lit("d"), "id").alias("id"), F.when(F.col("id") < 150, "big").when(F.col("id") < 190, "a/b c").alias("source"), F.array(F.lit("<x>"), F.lit("é\x01")).alias("t"), (F.col("id") > 5).alias("flag"), F.lit(None).cast("string").alias("none"))
    O.write_documents(docs, str(tmp_path / "j"), by="source", gzip=True, max_rows=7)
    names = sorted(f.name.rsplit("-", 1)[0] for f in (tmp_path / "j").iterdir())
    assert set(names) == {"big", "a-b-c", "documents"}
    got = [json.loads(x) for f in (tmp_path / "j").iterdir() for x in gzip.decompress(f.read_bytes()).decode().splitlines()]
    assert sorted(d["id"] for d in got) == sorted(f"d{i}" for i in range(200)) and set(got[0]) == {"id", "t", "flag", "none"}
    O.write_documents(docs, str(tmp_path / "x"), kind="xml")
    found = [d for f in (tmp_path / "x").iterdir() for d in ElementTree.fromstring(f.read_bytes())]
    assert len(found) == 200 and [(f.get("name"), f.text) for f in found[0]][-3:] == [("t", "<x>"), ("t", "é"), ("flag", found[0][-1].text)]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    docs = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 90, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        O.write_documents(docs, str(tmp_path / "o"))
    assert [f for f in (tmp_path / "o").iterdir() if not f.name.startswith(("_", "."))] == []


def test_a_replayed_batch_is_written_once(tmp_path):
    options = {"path": str(tmp_path)}
    shown = lambda: sorted(x for f in tmp_path.glob("*.jsonl") for x in f.read_text().splitlines())
    writer = O._StreamWriter(options)
    first = writer.write(iter([Row(id="1"), Row(id="2")]))
    assert shown() == []
    writer.commit([first, None], 0)
    again = O._StreamWriter(options).write(iter([Row(id="1"), Row(id="2")]))
    O._StreamWriter(options).commit([again], 0)
    assert shown() == ['{"id": "1"}', '{"id": "2"}'] and not list(tmp_path.glob("_?*-*"))
    # A commit that broke off after its mark is finished when the batch comes again
    half = writer.write(iter([Row(id="3")]))
    (tmp_path / O.DONE / "1").write_text(json.dumps(half.files))
    replay = writer.write(iter([Row(id="3")]))
    writer.commit([replay], 1)
    assert shown()[-1] == '{"id": "3"}' and len(shown()) == 3
    lost = writer.write(iter([Row(id="4")]))
    writer.abort([lost], 2)
    assert len(shown()) == 3 and not list(tmp_path.glob("_?*-*"))


def test_streams_are_written(spark, tmp_path):
    spark.dataSource.register(O.DocumentSink)
    spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("source")).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("id string, source string").parquet(str(tmp_path / "in"))
        stream.writeStream.format("documents_out").option("by", "source").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    lines = [json.loads(x)["id"] for f in (tmp_path / "out").glob("s-*.jsonl") for x in f.read_text().splitlines()]
    assert sorted(lines) == [str(i) for i in range(10)]

"""Queries against their SQL on inputs that the given tables don't hold."""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from cairn import registry
from cairn.functions import html as H
from cairn.functions import redaction as R
from cairn.plans import inputs_read


def differing(spark, folder, name, table, rows, schema):
    """Rows of the query that its SQL doesn't give, and the other way round."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    registry.queries()[name](spark, str(folder)).write.parquet(f"{folder}/out")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    con.execute(f"CREATE TABLE o AS {registry.oracle_sql()[name]}")
    con.execute(f"CREATE TABLE s AS SELECT * FROM '{folder}/out/*.parquet'")
    names = ", ".join(f'"{r[0]}"' for r in con.execute("DESCRIBE o").fetchall())
    return [con.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b}").fetchall() for a, b in ("os", "so")]


def test_targets_of_any_words_and_sources(spark, tmp_path):
    words = ["login", "Intent", "Hashtag", "media", "home", "with", "i", "", None, "1 ...", "a" * 15, "a" * 16, "b" * 101, "x_y"]
    sources = ["src0", None, "", "a b", "a&x=1#y", "50%", "a" * 20, "i", "home", " c ", '"q"']
    rows = [(w, lang, s) for w in words for lang in ("en", "de", "fr", "es", None) for s in sources]
    docs = [(i, w, lang, s, len(w or "")) for i, (w, lang, s) in enumerate(rows)]
    assert differing(spark, tmp_path, "f18_x_targets", "documents", docs, "doc_id long, text string, lang string, source string, n_chars long") == [[], []]


def test_long_numbers_are_no_statuses(spark, tmp_path):
    users = [2, 20, 29, 200, 299, 2000, 20_000, 29_999_999_999, 3, 300, 0, -2, -25, None]
    rows = [(i, u, k, p) for i, (u, k, p) in enumerate((u, k, p) for u in users for k in ("view", "error", "violet", "err", "VIEW", "purchase", "", None) for p in ('{"k": 7}', "", None))]
    assert differing(spark, tmp_path, "q10_q13_record_filters", "events", rows, "event_id long, user_id long, event_type string, props string") == [[], []]


def test_requests_of_a_query_are_cleaned_in_one_worker(spark):
    clean = R.redacted_requests(("pass",))
    rows = spark.createDataFrame([(i, f'{{"pass":{i}}}', f"pass={i}") for i in range(1200)], "i long, a string, b string").coalesce(1)
    none = F.lit(None).cast("string")
    out = rows.select("i", clean(F.col("a"), none, none)["body"].alias("a"), clean(F.col("b"), none, none)["body"].alias("b"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert {tuple(r)[1:] for r in out.collect()} == {('{"pass":"[REDACTED]"}', "pass=%5BREDACTED%5D")} and out.count() == 1200


def test_lists_are_files_of_one_folder(spark, tmp_path, monkeypatch):
    folder = tmp_path / "sums"
    monkeypatch.setattr(inputs_read, "shared_folder", lambda *_: str(folder))
    docs = [(i, None if i % 3 == 0 else f"s{i % 3}") for i in range(0, 5000, 7)]
    assert differing(spark, tmp_path, "k07_checksums", "documents", docs, "doc_id long, source string") == [[], []]
    assert not [p for p in folder.iterdir() if p.is_dir()]


def test_pages_are_read_in_parts(spark):
    assert [p.num_rows for p in H.parts(pa.record_batch({"x": list(range(250))}))] == [100, 100, 50]
    pages = spark.range(250).select("id", F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("html")).coalesce(1)
    assert {(r.id, r.text) for r in H.page_texts(pages, "html").select("id", "page.text").collect()} == {(i, str(i)) for i in range(250)}

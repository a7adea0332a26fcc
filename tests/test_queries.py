"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from cairn import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, tmp_path, name):
    registry.queries()[name](spark, SF).write.parquet(f"{tmp_path}/out")
    sql = registry.oracle_sql().get(name)
    n = con.execute(f"SELECT count(*) FROM '{tmp_path}/out/*.parquet'").fetchall()[0][0]
    if sql is None:
        assert n
        return
    con.execute(f"CREATE OR REPLACE TABLE o AS {sql}")
    con.execute(f"CREATE OR REPLACE TABLE s AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    cols = {t: {r[0]: r[1] for r in con.execute(f"DESCRIBE {t}").fetchall()} for t in "os"}
    assert cols["o"] == cols["s"]
    names = ", ".join(f'"{c}"' for c in sorted(cols["o"]))
    for a, b in ("os", "so"):
        assert con.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b} LIMIT 3").fetchall() == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

"""Streams over events that are dealt over several files, in no order of time."""

from __future__ import annotations

import pytest

from cairn import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["st13_tumbling_windows", "st3_boundary", "st4_block_backoff"])
def test_files_do_not_change_results(spark, tmp_path, name):
    spark.read.parquet(f"{SF}/events.parquet").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    rows = lambda sf: sorted(tuple(r) for r in registry.queries()[name](spark, sf).collect())
    got = rows(str(tmp_path))
    assert got and got == rows(SF)

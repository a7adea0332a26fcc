"""All queries over the archive operators, by survey id."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "a01_job_dedup_summary"
MODULES = ["archive", "scalars", "social", "jobs", "pages", "records", "more", "streams", "crawl", "platforms", "indexing", "timelines", "likeness", "hosts", "inputs_read"]


def _modules():
    return [importlib.import_module(f"cairn.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _modules():
        found.update(m.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _modules():
        found.update(m.ORACLE)
    return found

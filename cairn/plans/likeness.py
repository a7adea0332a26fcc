"""Queries of fuzzy hashes over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import fuzzy
from cairn.functions import platforms as P
from cairn.plans.catalog import Catalog
from cairn.plans.inputs import table, written

query = Catalog()
QUERIES, ORACLE = query.queries, query.sql


@query("h27_p21_fuzzy_hashes")
def h27(spark, sf):
    """No SQL makes these hashes; tests compare them with ones made byte by byte."""
    d = fuzzy.with_fuzzy(table(spark, sf, "documents").select("doc_id", "source", "text"), "text")
    block = lambda size, text: F.struct(size.alias("size"), text.alias("hash"))
    f = F.col("fuzzy")
    return d.select("doc_id", "fuzzy.size", P.fuzzy_text(F.array(block(f["size"] * 2, f["second"]), block(f["size"], f["first"])), F.col("source")).alias("fuzzy"))


@query("h27_fuzzy_search")
def h27_search(spark, sf):
    """Documents whose number can be divided by 20, asked for among all of them."""
    hashes = written(fuzzy.with_fuzzy(table(spark, sf, "documents").select("doc_id", "text"), "text"), "fuzzy")
    return fuzzy.alike(hashes, hashes.where("doc_id % 20 = 0"), "doc_id")

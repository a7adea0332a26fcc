"""Other inputs and outputs: JSON lines, JSON in pages and prose, metadata sheets, exports, checksums."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators import mapping


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that are JSON objects of the schema; blank and broken ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def crawl_config(spark: SparkSession, config: dict | str, schema: str) -> DataFrame:
    """A table of the seeds of a configuration: a dictionary, or text in JSON, or in YAML where its package is there."""
    if isinstance(config, str):
        try:
            config = json.loads(config)
        except ValueError:
            import yaml

            config = yaml.safe_load(config)
    return spark.createDataFrame(mapping.seed_rows(config), schema)


def json_map(rows: DataFrame, column: str, record: str) -> DataFrame:
    """(key, record fields) of a column that holds {id: {...}}."""
    found = rows.select(F.explode(F.from_json(column, f"map<string,{record}>")).alias("key", "r"))
    return found.select("key", "r.*")


def decode_documents(text: str | None) -> list[str]:
    """Concatenated JSON values, after a guard such as for(;;); is taken off; broken lines are skipped."""
    decoder, out = json.JSONDecoder(), []
    rest = re.sub(r"^\s*for\s*\(;;\);", "", text or "")
    at = 0
    while at < len(rest):
        found = re.compile(r"\S").search(rest, at)
        if not found:
            break
        at = found.start()
        try:
            value, at = decoder.raw_decode(rest, at)
            if isinstance(value, (dict, list)):
                out.append(json.dumps(value, sort_keys=True))
        except ValueError:
            nxt = rest.find("\n", at)
            if nxt < 0:
                break
            at = nxt + 1
    return out


def json_documents(rows: DataFrame, column: str) -> DataFrame:
    """rows with one row for each JSON value in column, as json."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def decoded(texts):  # noqa: ANN001, ANN202
        return texts.map(decode_documents)

    return rows.withColumn("json", F.explode(decoded(F.col(column)))).drop(column)


def embedded_json(html: Column, kind: str = "application/json") -> Column:
    """The contents of a page's scripts of a type."""
    return F.regexp_extract_all(html, F.lit(rf'(?is)<script[^>]*type="{re.escape(kind)}"[^>]*>(.*?)</script>'), 1)


def assigned_json(html: Column, name: str) -> Column:
    """The object that a page's script assigns to a name, or null."""
    return F.nullif(F.regexp_extract(html, rf"(?s){re.escape(name)}\s*=\s*(\{{.*?\}});\s*</script>", 1), F.lit(""))


def metadata_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(seed, pos, name, value) of a sheet whose first column is seed_url and whose column names may repeat; * or an empty seed is the job itself."""
    rows = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path)
    head = rows.first()
    if head is None or (head[0] or "").lstrip("﻿").strip().lower() != "seed_url":
        raise ValueError("the first column must be seed_url")
    names = list(head)[1:]
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), F.col(rows.columns[i + 1]).alias("value")) for i, n in enumerate(names)])
    seed = F.nullif(F.trim(F.coalesce(F.col(rows.columns[0]), F.lit(""))), F.lit(""))
    out = rows.where(F.lower(F.coalesce(F.regexp_replace(rows.columns[0], "^﻿", ""), F.lit(""))) != "seed_url").select(F.nullif(seed, F.lit("*")).alias("seed"), F.explode(cells).alias("c")).select("seed", "c.*")
    return out.where(F.trim("value") != "")


def csv_ready(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The given fields as text, arrays and structs as JSON; fields that aren't there are empty."""
    kinds = dict(rows.dtypes)
    one = lambda c: F.lit(None).cast("string").alias(c) if c not in kinds else (F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c).cast("string").alias(c))
    return rows.select(*[one(c) for c in fields])


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(line, name, sha256) of all files below path, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    return named.select(F.concat_ws("  ", "sha256", "name").alias("line"), "name", "sha256").orderBy("name")


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) below path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def replayed(log: DataFrame, key: str, at: str) -> DataFrame:
    """(key, post, files): files (kind 3) of each post (kind 2) in order; a file belongs to the last post before it in its log."""
    upto = W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    placed = log.withColumn("post", F.last("post", True).over(upto)).where("post IS NOT NULL")
    own = F.collect_list(F.when(F.col("kind") == 3, F.struct(at, "file")))
    return placed.groupBy(key, "post").agg(F.transform(F.array_sort(own), lambda x: x["file"]).alias("files"))


def first_object(text: str | None) -> str | None:
    """The first JSON object in prose, with or without a fence around it."""
    decoder, text = json.JSONDecoder(), text or ""
    at = text.find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0])
        except ValueError:
            at = text.find("{", at + 1)
    return None


def first_objects(rows: DataFrame, column: str) -> DataFrame:
    """rows with object in place of column: the first JSON object in its text, or null."""

    def find(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return rows.withColumn("object", F.pandas_udf(find, T.StringType())(column)).drop(column)

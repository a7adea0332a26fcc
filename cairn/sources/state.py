"""A state that is replaced as a whole: readers see the old one or the new one, never a part or nothing.

Each version is a folder of its own. Once all its files are committed, a small
file that names it is renamed over the one that names the version before; a job
that fails leaves that file, and so the old state, as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTER = "CURRENT"


def _files(spark: SparkSession, folder: str):
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    top = hadoop.Path(folder)
    return hadoop, top.getFileSystem(conf), hadoop.FileContext.getFileContext(top.getFileSystem(conf).getUri(), conf)


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the version that counts, or None before the first one."""
    hadoop, fs, _ = _files(spark, folder)
    pointer = hadoop.Path(f"{folder}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return f"{folder}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def replace(df: DataFrame, folder: str, kind: str = "json", keep_old: bool = False) -> str:
    """Writes df as the new version and then makes it the one that counts; the version before is deleted unless keep_old.

    df may be made from the version before. Two writers at a time don't mix
    their rows: the last one to finish counts.
    """
    spark = df.sparkSession
    before, name = current(spark, folder), f"v-{uuid.uuid4().hex}"
    df.write.format(kind).save(f"{folder}/{name}")
    hadoop, fs, context = _files(spark, folder)
    fresh = hadoop.Path(f"{folder}/.{name}")
    out = fs.create(fresh, True)
    out.write(name.encode())
    out.close()
    over = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, hadoop.Path(f"{folder}/{POINTER}"), over)
    if before and not keep_old:
        fs.delete(hadoop.Path(before), True)
    return f"{folder}/{name}"


def read(spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "json") -> DataFrame:
    """The state that counts; empty before the first one."""
    at = current(spark, folder)
    return spark.read.format(kind).schema(schema).load(at) if at else spark.createDataFrame([], schema)

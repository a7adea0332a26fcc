"""Stateful streams: first sightings, stops, back-off and windows over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder or one file of events as a stream; ts is its time.

    Without files_per_batch all files that are there make one batch, so that
    neither a watermark nor the order of rows depends on how they are dealt.
    """
    whole = spark.read.parquet(path)
    source = spark.readStream.schema(whole.schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    top, _, name = path.rstrip("/").rpartition("/")
    single = any(f.endswith(f"/{name}") for f in whole.inputFiles())
    stream = source.option("pathGlobFilter", name).parquet(top) if single else source.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def first_sightings(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, time: str, span: str, late: str, *keys: str) -> DataFrame:
    """(start, keys, n): rows of each window; windows are emitted when the watermark has passed them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, span).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, late: str, key: str) -> DataFrame:
    """(key, start, end, n): runs of rows that are less than gap apart."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding(stream: DataFrame, time: str, span: str, step: str, late: str, amount: str, key: str) -> DataFrame:
    """(key, end, used): what was used in each sliding window."""
    return stream.withWatermark(time, late).groupBy(F.window(time, span, step).alias("w"), key).agg(F.sum(amount).alias("used")).select(key, F.col("w.end").alias("end"), "used")


def backoff(stream: DataFrame, key: str, order: str, blocked: str, most: int) -> DataFrame:
    """(key, order, run, action): blocks in a row, and what to do: proceed, backoff, or stop from most on.

    State is one number for each key; rows of a key are taken in their order
    within each batch.
    """

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(order)
        runs = []
        for hit in rows[blocked]:
            run = run + 1 if hit else 0
            runs.append(run)
        state.update((run,))
        action = ["proceed" if r == 0 else "stop" if r >= most else "backoff" for r in runs]
        yield pd.DataFrame({key: own[0], order: rows[order].to_numpy(), "run": runs, "action": action})

    return stream.select(key, order, blocked).groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, run long, action string", "run long", "append", GroupStateTimeout.NoTimeout)


def boundary(stream: DataFrame, key: str, order: str, older: str, neutral: str, most: int) -> DataFrame:
    """(key, order, run, stop) up to the row at which so many older rows came one after another; neutral rows change nothing."""

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, stopped = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for at, is_older, is_neutral in zip(rows[order], rows[older], rows[neutral], strict=True):
            if stopped:
                break
            run = run + 1 if is_older else run if is_neutral else 0
            stopped = run >= most
            out.append((own[0], at, run, stopped))
        state.update((run, stopped))
        yield pd.DataFrame(out, columns=[key, order, "run", "stop"])

    return stream.select(key, order, older, neutral).groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, run long, stop boolean", "run long, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def enriched(stream: DataFrame, key: str, order: str, value: str, part: str) -> DataFrame:
    """(key, value, first_, kinds): the first value that is there, the first fragment, and how many kinds of them came; few kinds are expected."""
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(order, value)))[value]
    return stream.groupBy(key).agg(first.alias(value), F.min(order).alias("first_"), F.size(F.collect_set(part)).cast("long").alias("kinds"))


def upserted_stream(spark: SparkSession, stream: DataFrame, key: str, folder: str) -> DataFrame:
    """The latest row of each key that a stream of updates gives for what is there now."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(key, "r.*")


def drained(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for what is there now, written to folder and read back."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")

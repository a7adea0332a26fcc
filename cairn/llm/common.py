"""Shared pieces: folders for written tables, and numpy kernels over Arrow text.

The kernels see a column of texts as one byte buffer with offsets and work on
all its documents at once. White space and the letters A-Z are single bytes in
UTF-8, so words can be split and lower-cased on bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Java and RE2 class of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the kernels take at a time; a longer text is taken alone.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a worker; a longer row is sent alone.
BATCH_BYTES = 8 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, outlives executors. Inside temporary_tables it is deleted unless keep."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    here = _written_here.get()
    if here is not None and not keep:
        here.append(path)
    return spark.read.schema(df.schema).parquet(path)


_written_here: ContextVar[list[str] | None] = ContextVar("written_here", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end; results that read them must be stored by then."""
    paths: list[str] = []
    token = _written_here.set(paths)
    try:
        yield
    finally:
        _written_here.reset(token)
        for path in paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of doc_id as text, mod m; null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % F.lit(m)


def fresh(df: DataFrame | list[str], name: str) -> str:
    """A column name that df (or a list of names) doesn't have yet, in any case of its letters."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    while name.lower() in taken:
        name = "_" + name
    return name


# ---- labelled samples ------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, size: int, by_class: bool) -> DataFrame:
    """(doc_id, y, text): whole labelled documents, at most rows and at most size bytes of text in all, or of each class.

    Documents come in the order of the hashes of their ids; one that is larger
    than size alone is left out. Labels that are null or contradict each other
    for a document don't count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
    one = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).alias("y2")).where("y = y2").select("doc_id", "y")
    least = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = least(one.where("y = 0")).unionAll(least(one.where("y = 1"))) if by_class else least(one)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")
    sizes = own.groupBy("doc_id", "y").agg(F.sum(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    ids, used = [], {}
    for r in sizes:
        k = r.y if by_class else 0
        if used.get(k, 0) + r.size <= size:
            used[k] = used.get(k, 0) + r.size
            ids.append((r.doc_id,))
    return own.join(F.broadcast(docs.sparkSession.createDataFrame(ids, T.StructType([own.schema["doc_id"]]))), "doc_id")


# ---- Arrow text ------------------------------------------------------------


def _plain(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts; null counts as empty."""
    column = _plain(column)
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column), lo + 65536)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, where the session leaves Spark's own bound, so that rows of long texts don't pile up in a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def map_text(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], fn: Callable[[np.ndarray, np.ndarray], list], drop_text: bool = True, done: Callable[[], None] | None = None) -> DataFrame:
    """df with new columns that fn computes from whole texts: fn(bytes, offsets) -> an array for each of fields.

    A field whose name df has already gets underscores in front of it. What fn
    makes of a chunk of texts leaves the worker before the next chunk is read.
    done is called at the end of a task.
    """
    kept = [f for f in df.schema.fields if not (drop_text and f.name == text)]
    kept_names = [f.name for f in kept]
    names = [fresh(kept_names, n) for n, _ in fields]
    schema = T.StructType(kept + [T.StructField(n, t) for n, (_, t) in zip(names, fields, strict=True)])
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                at = [batch.schema.get_field_index(n) for n in kept_names]
                for lo, hi, buf, offs in chunks(batch.column(batch.schema.get_field_index(text))):
                    made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(fn(buf, offs), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in at] + made, names=kept_names + names)
        finally:
            if done:
                done()
            pa.default_memory_pool().release_unused()

    kinds = [to_arrow_type(t) for _, t in fields]
    return df.mapInArrow(run, schema)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (with one more at the end)."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    space = IS_SPACE[buf]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    full = offs[1:] > offs[:-1]
    before[offs[:-1][full]] = True
    after[offs[1:][full] - 1] = True
    inside = ~space
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_P, _INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length, A-Z lower-cased."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
        base = starts[i]
        part = buf[base : ends[j - 1]]
        power, inverse = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((LOWER[part] if lower else part).astype(np.uint64) * power[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        i = j
    return mix(out)


# ---- joins -----------------------------------------------------------------

#: A side of a join is broadcast up to this many bytes, found by counting its rows.
BROADCAST_BYTES = 32 << 20
#: A key with more than a HOT-th of all rows is dealt out; so there are at most HOT such keys.
HOT = 500


def row_bytes(df: DataFrame) -> int:
    """An estimate of a row's bytes in memory, for tables of short columns."""
    return 48 + sum(8 if isinstance(f.dataType, T.NumericType) else 64 for f in df.schema.fields)


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table of short columns may be broadcast."""
    most = limit // row_bytes(df)
    return df.limit(most + 1).count() <= most


def sized_join(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with small, which is broadcast if it fits and shuffled if not."""
    return rows.join(F.broadcast(small) if fits(small) else small, keys, how)


def dealt_join(rows: DataFrame, unique: DataFrame, keys: list[str], n: str, total: int, short: bool = True) -> DataFrame:
    """Inner join of rows with the one row that unique has for each key.

    Column n of unique says how many rows have the key, of total. Keys with more
    than a HOT-th of them are dealt out: both sides get a salt, and the row of
    unique is repeated for each salt. The list of hot keys has HOT entries at
    most, so it can be broadcast. short: unique has short columns, and is
    broadcast itself if it fits.
    """
    if short and fits(unique):
        return rows.join(F.broadcast(unique), keys)
    parts = F.ceil(F.col(n) * HOT / F.lit(max(total, 1))).cast("int")
    hot = unique.where(F.col(n) * HOT > F.lit(total)).select(*keys, parts.alias("_parts"))
    spread = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    repeated = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(n) * HOT > F.lit(total), parts - 1).otherwise(F.lit(0)))))
    return spread.join(repeated, [*keys, "_salt"]).drop("_salt")

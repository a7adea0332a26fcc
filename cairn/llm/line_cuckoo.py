"""Line dedup with sharded cuckoo filters over exact reference counts.

A line's key is the line stripped of white space at both ends, A-Z lower-cased.
The reference table counts, for each key (a 128-bit hash), the documents that
hold it; it is exact, grows by inserted documents and shrinks by deleted ones,
so dedup over changing documents can be undone. Keys in at least MIN_DOCS
documents are common. Each shard of the common keys has a cuckoo filter, from
which keys can be deleted again when their count falls. A line is looked up in
its shard's filter first, and only a hit in the exact table.

Filters are broadcast if they all fit FILTER_BYTES, the exact table if it fits
EXACT_BYTES; beyond that lines are joined with the table by a shuffle. Results
are the same either way. A task holds the keys of one Arrow batch or one shard.

Defined results: a null or empty text is one empty line; lines whose key is
shorter than MIN_CHARS code points are never common and always stay; a text
that loses all its lines becomes empty; each row counts as a document, so
repeated rows and null doc_ids count too. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import chunks, map_text, written

MIN_CHARS, MIN_DOCS = 1, 10
SHARD_KEYS = 50_000
FILTER_BYTES, EXACT_BYTES = 32 << 20, 32 << 20
_BLANK = b" \t\n\x0b\x0c\r"


def texts(buf: np.ndarray, offs: np.ndarray) -> Iterator[bytes]:
    whole = buf.tobytes()
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        yield whole[a:b]


def key_of(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The hash of a line's key, or None if the key is too short to be common."""
    key = line.strip(_BLANK).lower()  # bytes: lower() changes A-Z only
    if len(key) < min_chars or min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; each key has two buckets. Never misses a key it holds."""

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / 4 / 0.84))))
            table = np.zeros((buckets, 4), np.uint16)
        self.table, self.mask = table, len(table) - 1

    @staticmethod
    def halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and first buckets (before the mask) of keys, an array of shape (n, 2)."""
        return ((keys[:, 1] >> np.uint64(48)) | np.uint64(1)).astype(np.uint16), keys[:, 0]

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f, h = self.halves(keys)
        one = (h & np.uint64(self.mask)).astype(np.int64)
        return f, one, self.other(one, f)

    def other(self, bucket, f):
        return bucket ^ ((np.asarray(f).astype(np.int64) * 0x5BD1E995 >> 3) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        f, one, two = self.places(keys)
        return (self.table[one] == f[:, None]).any(1) | (self.table[two] == f[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if the table is too full; it must then be rebuilt larger."""
        for f, one, two in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for bucket in (one, two):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = f
                    break
            else:
                bucket = two
                for turn in range(500):
                    f, self.table[bucket, turn % 4] = int(self.table[bucket, turn % 4]), f
                    bucket = int(self.other(bucket, f))
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = f
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted before."""
        for f, one, two in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == f)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    @staticmethod
    def of(keys: np.ndarray) -> CuckooFilter:
        size = max(8, len(keys))
        while not (made := CuckooFilter(size)).insert(keys):
            size *= 2
        return made


def as_keys(digests: list[bytes] | bytes) -> np.ndarray:
    return np.frombuffer(digests if isinstance(digests, bytes) else b"".join(digests), np.uint64).reshape(-1, 2)


def counted(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The reference table (key, n): documents that hold each key; counted in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for _, _, buf, offs in chunks(batch.column(0)):
                for text in texts(buf, offs):
                    found.update({k for line in text.split(b"\n") if (k := key_of(line, min_chars)) is not None})
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def updated(counts: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """The reference table after documents came and went; deleted ones must have been inserted before."""
    parts = counts
    if inserted is not None:
        parts = parts.unionByName(counted(inserted, min_chars))
    if deleted is not None:
        parts = parts.unionByName(counted(deleted, min_chars).withColumn("n", -F.col("n")))
    return parts.groupBy("key").agg(F.sum("n").alias("n")).where("n <> 0")


def _shard(n: int) -> Column:
    """The shard of a key: four of its bytes, which neither the bucket nor the fingerprint is taken from; the same as shard_of."""
    return F.pmod(F.conv(F.hex(F.substring("key", 9, 4)), 16, 10).cast("long"), F.lit(n)).cast("int")


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return keys[:, 1].astype(np.uint32).byteswap() % np.uint32(n)


def shards_for(common: DataFrame) -> int:
    return max(1, -(-common.count() // SHARD_KEYS))


FILTER_SCHEMA = "shard int, size int, filter binary, keys binary"


def filters(common: DataFrame, n_shards: int) -> DataFrame:
    """(shard, size, filter, keys) of the common keys: a cuckoo filter for each shard, and its keys."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = b"".join(map(bytes, pdf["key"]))
        made = CuckooFilter.of(as_keys(keys))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "size": [len(pdf)], "filter": [made.table.tobytes()], "keys": [keys]})

    return common.select("key", _shard(n_shards).alias("shard")).groupBy("shard").applyInPandas(build, FILTER_SCHEMA)


def maintained(old: DataFrame, before: DataFrame, after: DataFrame, n_shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """old filters brought from reference table before to after: keys that became common go in, others come out."""
    was, now = before.where(F.col("n") >= min_docs).select("key"), after.where(F.col("n") >= min_docs).select("key")
    moved = now.join(was, "key", "left_anti").withColumn("up", F.lit(True)).unionByName(was.join(now, "key", "left_anti").withColumn("up", F.lit(False)))

    def change(have: pd.DataFrame, move: pd.DataFrame) -> pd.DataFrame:
        shard = int((have if len(have) else move)["shard"].iloc[0])
        up, down = ([bytes(k) for k in move["key"][move["up"] == flag]] for flag in (True, False))
        held = bytes(have["keys"].iloc[0]) if len(have) else b""
        gone = set(down)
        keys = b"".join(k for i in range(0, len(held), 16) if (k := held[i : i + 16]) not in gone) + b"".join(up)
        made = CuckooFilter(table=np.frombuffer(bytes(have["filter"].iloc[0]), np.uint16).reshape(-1, 4).copy()) if len(have) else CuckooFilter(8)
        made.delete(as_keys(down))
        if not made.insert(as_keys(up)):
            made = CuckooFilter.of(as_keys(keys))
        return pd.DataFrame({"shard": [shard], "size": [len(keys) // 16], "filter": [made.table.tobytes()], "keys": [keys]})

    return old.groupBy("shard").cogroup(moved.withColumn("shard", _shard(n_shards)).groupBy("shard")).applyInPandas(change, FILTER_SCHEMA)


def screened(tables: list[bytes], keys: np.ndarray) -> np.ndarray:
    """Whether the filter of each key's shard may hold it; a shard without keys has an empty filter."""
    hit, shard = np.zeros(len(keys), bool), shard_of(keys, len(tables))
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(len(tables) + 1))
    for i, t in enumerate(tables):
        own = order[ends[i] : ends[i + 1]]
        if len(own) and t:
            hit[own] = CuckooFilter(table=np.frombuffer(t, np.uint16).reshape(-1, 4)).contains(keys[own])
    return hit


def sorted_keys(keys: np.ndarray) -> np.ndarray:
    return keys[np.lexsort((keys[:, 1], keys[:, 0]))]


def among(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted table: found by the first half, compared by the second."""
    lo, hi = (np.searchsorted(table[:, 0], keys[:, 0], side) for side in ("left", "right"))
    hit = np.zeros(len(keys), bool)
    at = np.flatnonzero(hi > lo)
    while len(at):  # once, but for keys that share their first half
        hit[at] |= table[lo[at], 1] == keys[at, 1]
        lo[at] += 1
        at = at[hi[at] > lo[at]]
    return hit


def _dropped(text: bytes, is_common, min_chars: int) -> tuple[int, int, str]:
    lines = text.split(b"\n")
    keep = [x for x in lines if (k := key_of(x, min_chars)) is None or not is_common(k)]
    return len(lines), len(lines) - len(keep), hashlib.sha256(b"\n".join(keep)).hexdigest()


FIELDS = [("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_sha256", T.StringType())]


def deduped(docs: DataFrame, counts: DataFrame | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, filter_bytes: int = FILTER_BYTES, exact_bytes: int = EXACT_BYTES, digest: bool = True) -> DataFrame:
    """docs (doc_id, text) with n_lines, n_dropped and kept_sha256 for text, or with the kept text itself.

    counts: the reference table, by default that of docs.
    """
    docs = docs.select("doc_id", "text")
    counts = counted(docs, min_chars) if counts is None else counts
    common = written(counts.where(F.col("n") >= min_docs).select("key"), "lines-common")
    n_shards = shards_for(common)
    shards = written(filters(common, n_shards), "lines-filters")
    sizes = shards.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0)).alias("f"), F.coalesce(F.sum(F.length("keys")), F.lit(0)).alias("k")).first()
    spark = docs.sparkSession
    tables = None
    if sizes.f <= filter_bytes:
        made = {r["shard"]: bytes(r["filter"]) for r in shards.select("shard", "filter").collect()}
        tables = [made.get(i, b"") for i in range(n_shards)]
    shared = spark.sparkContext.broadcast(tables)
    fields = FIELDS if digest else [("kept_text", T.BinaryType())]

    def results(buf: np.ndarray, offs: np.ndarray, common_of) -> list:
        out = []
        for i, text in enumerate(texts(buf, offs)):
            if digest:
                out.append(_dropped(text, common_of(i), min_chars))
            else:
                out.append((b"\n".join(x for x in text.split(b"\n") if (k := key_of(x, min_chars)) is None or not common_of(i)(k)),))
        return [list(x) for x in zip(*out, strict=True)]

    if tables is not None and sizes.k <= exact_bytes:
        held = b"".join(bytes(r["keys"]) for r in shards.select("keys").collect())
        exact = spark.sparkContext.broadcast(sorted_keys(as_keys(held)))

        def run(buf: np.ndarray, offs: np.ndarray) -> list:
            seen = list({k for text in texts(buf, offs) for line in text.split(b"\n") if (k := key_of(line, min_chars)) is not None})
            keys = as_keys(seen)
            maybe = np.flatnonzero(screened(shared.value, keys))
            common = {seen[i] for i in maybe[among(exact.value, keys[maybe])]}
            return results(buf, offs, lambda i: common.__contains__)

        return map_text(docs, "text", fields, run)

    # By shuffle: (document, key) of lines that pass the filters, if these can be broadcast, joined with the exact table.
    marked = docs.withColumn("_t", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)))

    def held_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, shas = [], batch.column(1), batch.column(2)
            keys: list[bytes] = []
            for lo, _, buf, offs in chunks(batch.column(0)):
                for i, text in enumerate(texts(buf, offs)):
                    own = {k for line in text.split(b"\n") if (k := key_of(line, min_chars)) is not None}
                    keys.extend(own)
                    at.extend([lo + i] * len(own))
            hit = np.flatnonzero(screened(shared.value, as_keys(keys))) if shared.value is not None and keys else np.arange(len(keys))
            rows = pa.array(np.array(at, np.int64)[hit] if len(hit) else [], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(rows), shas.take(rows), pa.array([keys[i] for i in hit], pa.binary())], names=["_id", "_t", "key"])

    pairs = marked.select("text", "_id", "_t").mapInArrow(held_keys, "_id long, _t string, key binary").join(common, "key").groupBy("_id", "_t").agg(F.array_sort(F.collect_set("key")).alias("_keys"))
    joined = marked.join(pairs, ["_id", "_t"], "left")
    joined = joined.select("doc_id", "text", F.concat_ws("", F.transform("_keys", lambda k: F.hex(k))).alias("_keys"))
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(n, t) for n, t in fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [frozenset(bytes.fromhex(k[i : i + 32]) for i in range(0, len(k or ""), 32)) for k in batch.column(2).to_pylist()]
            parts: list[list] = [[] for _ in fields]
            for lo, _, buf, offs in chunks(batch.column(1)):
                for part, x in zip(parts, results(buf, offs, lambda i, lo=lo: own[lo + i].__contains__), strict=True):
                    part.extend(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p) for p in parts)], names=["doc_id", *(n for n, _ in fields)])

    return joined.mapInArrow(finish, schema)


#: Rows are documents, whatever their ids.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY r, doc_id
"""

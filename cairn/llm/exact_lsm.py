"""Exact dedup with a log-structured merge index of text digests.

Memtables: each task of a scan holds the digests of its share of the input,
sorts them and flushes them as a run. Compaction merges runs into one level
that keeps the smallest identifier and the number of rows for each digest;
compacting that level again with the runs of a later batch gives the same index
as one pass over all. A level has a Bloom filter (blocks of 32768 bits, two
bits for each digest) and is sorted, so that files know their range of digests.
A lookup asks the filter and the range first, and only what passes is joined
with the level. Rows whose digest is in the index more than once are hits and
are verified byte by byte: they are grouped by their whole text.

Only DataFrame operations. Equality is that of the normalised text: each run of
white space becomes one space. No group of copies is gathered: counts and texts
are aggregated before they are shuffled, and digests that hold more than a
HOT-th of all rows are dealt out over many tasks in joins.

Defined results: a null text counts as empty, and all empty texts are equal;
a text of white space only equals one space. With repeated doc_ids each row
gets its own result row. Exactly one row of a group is kept; of rows that share
the smallest doc_id any one in dedup, and in kept_documents the least by its
columns. A null doc_id is larger than any other; a group of only nulls has a
null keep_id and keeps one row. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import BROADCAST_BYTES, SPACE, dealt_join, fits, fresh, sized_join, written

#: Stands for a null doc_id while rows are compared.
_LAST = (1 << 63) - 1
#: Bits of a filter's block (those of Spark's bitmap functions), and bits for each digest.
BLOCK, BITS = 32768, 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def flush(docs: DataFrame) -> DataFrame:
    """Memtables of (id, digest, row) written as sorted runs, one for each task; row tells rows apart."""
    rows = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), digest_of(normalised(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return written(rows.sortWithinPartitions("digest", "id"), "exact-run")


def compact(*levels: DataFrame) -> DataFrame:
    """One level (digest, keep, keep_row, n) of runs (id, digest, row) and earlier levels."""
    one = lambda x: x.select("digest", F.struct(F.col("id").alias("keep"), F.col("row").alias("keep_row")).alias("least"), F.lit(1).cast("long").alias("n"))
    parts = [x.select("digest", F.struct("keep", "keep_row").alias("least"), "n") if "n" in x.columns else one(x) for x in levels]
    merged = parts[0]
    for x in parts[1:]:
        merged = merged.unionByName(x)
    return merged.groupBy("digest").agg(F.min("least").alias("least"), F.sum("n").alias("n")).select("digest", "least.*", "n")


def stored(level: DataFrame) -> DataFrame:
    """A level written as files that each hold a range of digests."""
    return written(level.repartitionByRange("digest").sortWithinPartitions("digest"), "exact-level")


def _bits(blocks: int) -> tuple[Column, Column, Column]:
    """A digest's block and its two bits there."""
    h = F.xxhash64("digest")
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)).alias("block"), F.pmod(h, F.lit(BLOCK)), F.pmod(F.shiftrightunsigned(h, 15), F.lit(BLOCK))


def _is_set(at: Column) -> Column:
    byte = F.conv(F.hex(F.col("bits").substr(F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[byte.bitwiseAND(F.lit(1 << k)) for k in range(8)]), (at % 8).cast("int")) != 0


def filter_of(level: DataFrame) -> tuple[DataFrame, int] | None:
    """A level's filter (block, bits) and its number of blocks, or None if it is too large to be broadcast."""
    keys = level.count()
    blocks = max(1, -(-keys * BITS // BLOCK))
    if blocks * (BLOCK // 8 + 64) > BROADCAST_BYTES:
        return None
    block, one, two = _bits(blocks)
    bits = level.select(block, F.explode(F.array(one, two)).alias("bit"))
    return written(bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), "exact-filter"), blocks


def lookup(batch: DataFrame, level: DataFrame, total: int) -> DataFrame:
    """The rows of batch (digest, ...) whose digest is in the stored level, with keep, keep_row and n; total: rows of batch."""
    found = filter_of(level)
    if found:
        bits, blocks = found
        block, *places = _bits(blocks)
        batch = batch.withColumn("block", block).join(F.broadcast(bits), "block").where(_is_set(places[0]) & _is_set(places[1])).drop("block", "bits")
    ends = level.agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).first()
    if ends.lo is None:
        return batch.join(level.limit(0), "digest")
    return dealt_join(batch.where(F.col("digest").between(F.lit(bytes(ends.lo)), F.lit(bytes(ends.hi)))), level, ["digest"], "n", total)


def collided(docs: DataFrame, hits: DataFrame) -> DataFrame | None:
    """(id, digest, other) of hits (id, digest) whose digest belongs to unlike texts; other tells these apart. None without any, as is expected.

    Equal texts are one row of a partial aggregate, so a large group of copies is
    not gathered: its text crosses the shuffle once for each task.
    """
    texts = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("id"), "text")
    found = sized_join(texts, hits.dropDuplicates(["id", "digest"]), ["id"]).select("id", "digest", normalised(F.col("text")).alias("norm"))
    found = found.where(digest_of(F.col("norm")) == F.col("digest"))
    unlike = found.groupBy("digest", "norm").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
    unlike = written(unlike.select("digest"), "exact-unlike")
    if unlike.isEmpty():
        return None
    return written(sized_join(found, unlike, ["digest"]).select("id", "digest", F.unhex(F.sha2("norm", 512)).alias("other")).distinct(), "exact-other")


def _placed(docs: DataFrame) -> DataFrame:
    """(id, digest, other, keep, n, kept) for each row of docs, written; other is empty unless unlike texts have the digest."""
    none = F.lit(b"")
    docs = docs.select("doc_id", "text")
    run = flush(docs)
    total = run.count()
    copies = stored(compact(run).where("n > 1"))
    hits = written(lookup(run, copies, total), "exact-hits")
    alone = run.join(F.broadcast(copies.select("digest")), "digest", "left_anti") if fits(copies) else run.join(hits.select("row"), "row", "left_anti")
    others = collided(docs, hits.select("id", "digest"))
    if others is not None:  # one digest for unlike texts: they form groups by their other digest
        apart = hits.select("id", "digest", "row").join(others, ["id", "digest"], "left").withColumn("other", F.coalesce("other", none))
        groups = apart.groupBy("digest", "other").agg(F.min(F.struct(F.col("id").alias("keep"), F.col("row").alias("keep_row"))).alias("least"), F.count("*").alias("n"))
        hits = apart.join(groups, ["digest", "other"]).select("id", "digest", "other", "row", "least.*", "n")
    else:
        hits = hits.withColumn("other", none)
    out = hits.select("id", "digest", "other", "keep", "n", (F.col("row") == F.col("keep_row")).alias("kept"))
    alone = alone.select("id", "digest", none.alias("other"), F.col("id").alias("keep"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("kept"))
    return written(out.unionByName(alone), "exact-placed")


def _real(c: str) -> Column:
    return F.when(F.col(c) != _LAST, F.col(c))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (doc_id, text)."""
    return _placed(docs).select(_real("id").alias("doc_id"), _real("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    placed = _placed(docs).where("n > 1").groupBy("id", "digest", "other").agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    placed = written(placed.where("NOT stays OR rows > 1"), "exact-dropped")
    doc_id, digest, other, stays = (fresh(docs, c) for c in ("_id", "_digest", "_other", "_stays"))
    gone = placed.select(F.col("id").alias(doc_id), F.col("digest").alias(digest), F.col("other").alias(other), F.col("stays").alias(stays))
    side = F.broadcast(gone) if fits(gone) else gone
    # Not an equality for Spark: else the digest would be a join key, computed for every row and not for those of found ids only.
    norm = normalised(F.col("text"))
    same = F.array_contains(F.array(digest), digest_of(norm)) & ((F.length(other) == 0) | F.array_contains(F.array(other), F.unhex(F.sha2(norm, 512))))
    match = (F.coalesce(docs["doc_id"], F.lit(_LAST)) == F.col(doc_id)) & same
    out = docs.join(side, match, "left_anti")
    repeated = written(gone.where(stays), "exact-repeated")
    if repeated.isEmpty():
        return out
    # Rows that share doc_id and text with the row that stays: one of them.
    least = F.first if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in docs.schema.fields) else F.min
    rows = docs.join(F.broadcast(repeated) if fits(repeated) else repeated, match)
    one = rows.groupBy(doc_id, digest, other).agg(least(F.struct(*[docs[c] for c in docs.columns])).alias(stays))
    return out.unionByName(one.select(f"{stays}.*"))

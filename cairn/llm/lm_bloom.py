"""Language-model scoring from a log-frequency Bloom filter of n-gram counts.

Unigrams and bigrams of the training texts are counted exactly. A count is
quantised to the level of its logarithm, and an n-gram of level q is put into a
Bloom filter q times, as (n-gram, 1) to (n-gram, q). To look up a count, levels
are probed one after another until one is missing; the filter never gives less
than the true level. Probabilities of bigrams and unigrams are interpolated.

Every counted n-gram is kept. The filter is made of segments, each built by the
task that adds up the counts of its n-grams and as large as they need. Each
executor gets a filter as one file that its workers map, of FILTER_BITS at most:
larger filters are cut into shards of whole segments. The texts are scored in one pass for each
bigram shard; a token's bigram lies in one shard, so the passes' sums add up to
the same score. If there is more than one unigram shard, passes before that
write the unigram levels of all tokens (a byte each) beside the texts.

The add-one base score needs exact counts: those of the HEAD most frequent
tokens are broadcast (16 bytes each), the others are joined by a shuffle in
which no key is frequent. Tokens are told apart by 64-bit hashes of their bytes.

Defined results: a null or empty text is one end token; repeated rows are
scored and counted like others; rows with a null doc_id are scored but not
learned from. Without training rows N and V are 0, and every token has base
probability one and score as the smoothed unigram. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bounded_batches, chunks, mix, shared_dir, word_hashes, word_spans, written

BASE, LEVELS = 1.5, 64
BITS_PER_ITEM, PROBES = 12, 5
SEGMENT_BITS, BLOCK_BITS, FILTER_BITS = 1 << 22, 512, 1 << 31
#: Bytes of text for each segment of a filter.
SEGMENT_TEXT = 1 << 20
HEAD = 500_000
#: Weight of the bigram estimate.
BIGRAM_WEIGHT = 0.2
FLUSH_TOKENS = 2_000_000

_END, _START = np.uint64(0x8F1BBCDC5A827999), np.uint64(0xCA62C1D66ED9EBA1)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens and of the bigrams that they end, and each document's first token (one more at the end)."""
    starts, ends, first = word_spans(buf, offs)
    n = len(offs) - 1
    out = np.empty(len(starts) + n, np.uint64)
    edges = first + np.arange(n + 1)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))] = word_hashes(buf, starts, ends)
    out[edges[1:] - 1] = _END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[edges[:-1]] = _START
    return out, mix(before * np.uint64(0x9E3779B97F4A7C15) + (out ^ (out >> np.uint64(31)))), edges


def counts(docs: DataFrame) -> DataFrame:
    """(bigram, h, n): counts of tokens and bigrams in docs (text), still to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k in (0, 1):
                if held[k]:
                    h, n = np.unique(np.concatenate(held[k]), return_counts=True)
                    held[k].clear()
                    for i in range(0, len(h), 65536):
                        part = slice(i, i + 65536)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[part]), bool(k))), pa.array(h[part].view(np.int64)), pa.array(n[part])], names=["bigram", "h", "n"])

        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(0)):
                one, two, _ = tokens(buf, offs)
                held[0].append(one)
                held[1].append(two)
                size += len(one)
                if size >= FLUSH_TOKENS:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "bigram boolean, h long, n long")


def level(n: Column, least: int) -> Column:
    return F.least(F.floor(F.log(n / F.lit(float(least))) / F.lit(float(np.log(BASE))) + F.lit(1e-9)) + 1, F.lit(LEVELS)).cast("int")


def values(least: int) -> np.ndarray:
    """What each level stands for: the mean of the whole counts in its range; 0 for level 0."""
    out = [0.0]
    for q in range(LEVELS):
        lo, hi = least * BASE**q, least * BASE ** (q + 1)
        first = int(np.ceil(lo - 1e-6))
        last = int(np.ceil(hi - 1e-6)) - 1
        out.append((first + last) / 2 if last >= first else (lo + hi) / 2)
    return np.array(out)


def _blocks(h: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Each n-gram's block among the n of its segment: all its levels lie in one block, one line of a processor's cache."""
    return ((h & np.uint64(0xFFFFFFFF)) * np.asarray(n).astype(np.uint64)) >> np.uint64(32)


def _bits(h: np.ndarray, q: int) -> np.ndarray:
    """What the places of (n-gram, level) in the block are taken from, nine bits for each probe."""
    return mix(h + np.uint64(q * 0x632BE59BD9B4E019 & (2**64 - 1)))


def _place(g: np.ndarray, probe: int) -> np.ndarray:
    return (g >> np.uint64(9 * probe)) & np.uint64(BLOCK_BITS - 1)


def segment_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def built(rows: DataFrame, least: int, n_segments: int) -> DataFrame:
    """(bigram, seg, blocks, bits, h, n): the segments of the filters of rows (bigram, h, n), and for unigrams also their counts, with null bits.

    rows may hold several counts of an n-gram; they are added up.
    """

    def build(part: pa.Table) -> pa.Table:
        bigram, seg = part["bigram"][0].as_py(), part["seg"][0].as_py()
        h, back = np.unique(part["h"].to_numpy(), return_inverse=True)
        n = np.zeros(len(h), np.int64)
        np.add.at(n, back, part["n"].to_numpy())
        q = np.minimum(np.floor(np.log(n / float(least)) / np.log(BASE) + 1e-9).astype(np.int64) + 1, LEVELS)
        u, blocks = h.view(np.uint64), max(1, -(-int(q.sum()) * BITS_PER_ITEM // BLOCK_BITS))
        at = (_blocks(u, blocks) * np.uint64(BLOCK_BITS)).astype(np.int64)
        on = np.zeros(blocks * BLOCK_BITS, bool)
        for k in range(1, int(q.max()) + 1):
            own = q >= k
            g, own_at = _bits(u[own], k), at[own]
            for probe in range(PROBES):
                on[own_at + _place(g, probe).astype(np.int64)] = True
        more = 0 if bigram else len(h)
        nulls = lambda kind: pa.nulls(more, kind)
        cat = lambda x, y: pa.concat_arrays([x, y])
        return pa.Table.from_arrays([
            pa.array(np.full(more + 1, bigram)), pa.array(np.full(more + 1, seg, np.int32)), cat(pa.array([blocks], pa.int32()), nulls(pa.int32())),
            cat(pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary()), nulls(pa.binary())), cat(pa.nulls(1, pa.int64()), pa.array(h[:more])), cat(pa.nulls(1, pa.int64()), pa.array(n[:more])),
        ], names=["bigram", "seg", "blocks", "bits", "h", "n"])

    seg = F.expr(f"cast(shiftrightunsigned(shiftrightunsigned(h, 32) * {n_segments}L, 32) as int)")
    return rows.select("bigram", seg.alias("seg"), "h", "n").groupBy("bigram", "seg").applyInArrow(build, "bigram boolean, seg int, blocks int, bits binary, h long, n long")


class Filter:
    """bits of the segments that blocks gives a size, in their order; n-grams of other segments have level 0."""

    def __init__(self, bits: np.ndarray | str, blocks: np.ndarray):
        self.bits, self.blocks = mapped(bits) if isinstance(bits, str) else bits, blocks
        self.starts = np.cumsum(blocks) - blocks

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram: probes level after level until one is missing."""
        out = np.zeros(len(h), np.int8)
        seg = segment_of(h, len(self.blocks)).astype(np.int64)
        alive = np.flatnonzero(self.blocks[seg])
        h, seg = h[alive], seg[alive]
        base = (self.starts[seg].astype(np.uint64) + _blocks(h, self.blocks[seg])) * np.uint64(BLOCK_BITS)
        for q in range(1, LEVELS + 1):
            g = _bits(h, q)
            for probe in range(PROBES):
                where = base + _place(g, probe)
                hit = np.flatnonzero((self.bits[(where >> np.uint64(3)).view(np.int64)] >> (where & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
                alive, h, base, g = alive[hit], h[hit], base[hit], g[hit]
            if not len(alive):
                break
            out[alive] = q
        return out


def sizes(segments: DataFrame, n_segments: int) -> np.ndarray:
    """The blocks of each segment (seg, blocks)."""
    out = np.zeros(n_segments, np.int64)
    for r in segments.select("seg", "blocks").toLocalIterator():
        out[r.seg] = r.blocks
    return out


def cuts(blocks: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Runs of segments, of at most bits each unless a segment alone is larger."""
    out, lo, held = [], 0, 0
    for i, b in enumerate(blocks.tolist()):
        if held and (held + b) * BLOCK_BITS > bits:
            out.append((lo, i))
            lo, held = i, 0
        held += b
    return [*out, (lo, len(blocks))]


def placed(segments: DataFrame, blocks: np.ndarray, lo: int, hi: int) -> tuple[str, np.ndarray]:
    """The filter of the segments from lo to hi as a file that each executor gets once, and the blocks of its segments.

    The file is written segment by segment, so it isn't held by the driver, and
    mapped by all workers of an executor, so they share its pages.
    """
    spark = segments.sparkSession
    own = np.zeros_like(blocks)
    own[lo:hi] = blocks[lo:hi]
    name = f"lm-filter-{uuid.uuid4().hex}"
    top = shared_dir(spark)
    uri = f"{top if '://' in top else 'file://' + os.path.abspath(top.removeprefix('file:'))}/{name}"
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path, compression=None) as out:
        for r in segments.where(F.col("seg").between(lo, hi - 1)).orderBy("seg").select("bits").toLocalIterator():
            out.write(bytes(r.bits))
    spark.sparkContext.addFile(uri)
    return name, own


@lru_cache(maxsize=4)
def mapped(name: str) -> np.ndarray:
    """A placed filter's bits in a worker."""
    path = SparkFiles.get(name)
    return np.asarray(np.memmap(path, np.uint8, "r")) if os.path.getsize(path) else np.zeros(0, np.uint8)


def gathered(rows: DataFrame, least: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter of rows (h, n) in one array; an error if it is larger than bits."""
    segments = written(built(rows.select(F.lit(True).alias("bigram"), "h", "n"), least, 1), "lm-filter")
    blocks = sizes(segments, 1)
    if blocks.sum() * BLOCK_BITS > bits:
        raise ValueError(f"a filter of {blocks.sum() * BLOCK_BITS} bits, {bits} at most")
    name, own = placed(segments, blocks, 0, 1)
    return mapped(name), own


def scored(docs: DataFrame, learned: Column, head_size: int = HEAD, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs (doc_id, text) with n_tokens, n_known, train_tokens, base_score and score; learned says which rows are learned from."""
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.where(learned)
    n_docs_trained, n_bytes = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Of the parts of a filter of all tokens (of four bytes) at least four go into a shard.
    n_segments = 1 + max(n_bytes // SEGMENT_TEXT, n_bytes * BITS_PER_ITEM // filter_bits)
    exact = written(built(counts(own), 1, n_segments), "lm-counts")
    one = exact.where("h is not null").select("h", "n")
    segments1, segments2 = (exact.where(F.col("blocks").isNotNull() & (F.col("bigram") == k)).select("seg", "blocks", "bits") for k in (False, True))
    total = one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, n_types = total["n"], total["v"]
    top = one.orderBy(F.desc("n"), "h").limit(head_size).toArrow()
    order = np.argsort(top["h"].to_numpy(), kind="stable")
    head = spark.sparkContext.broadcast((top["h"].to_numpy()[order], top["n"].to_numpy()[order]))
    whole, denominator = n_types <= head_size, float(n_train + n_types + 1)
    blocks1, blocks2 = sizes(segments1, n_segments), sizes(segments2, n_segments)
    shards1, shards2 = cuts(blocks1, filter_bits), cuts(blocks2, filter_bits)
    n_shards, stored = len(shards2), len(shards1) > 1
    # Rows are told apart where results of several passes meet; a single pass's own result is written with them.
    keyed = docs.withColumn("row", F.monotonically_increasing_id())
    if n_shards > 1 or stored:
        keyed = written(keyed, "lm-rows")
    keyed = keyed.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    unigrams = None
    if stored:
        keyed = keyed.withColumn("levels", F.lit(None).cast("binary"))
        for lo, hi in shards1:
            shared = spark.sparkContext.broadcast(placed(segments1, blocks1, lo, hi))
            keyed = written(keyed.mapInArrow(_unigram_levels(shared), keyed.schema), "lm-levels")
    else:
        unigrams = placed(segments1, blocks1, 0, n_segments)

    def add_pass(k: int) -> DataFrame:
        from_, to = shards2[k]
        shared = spark.sparkContext.broadcast((unigrams, placed(segments2, blocks2, from_, to)))
        first = k == 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f1, f2 = (Filter(*x) if x else None for x in shared.value)
            heads, head_n = head.value
            v = values(1)
            for batch in batches:
                parts: list[list] = [[] for _ in range(6)]
                held, at_token = _held(batch.column(3)) if stored else None, 0
                for _, _, buf, offs in chunks(batch.column(2)):
                    h1, h2, edges = tokens(buf, offs)
                    lo, n_docs = edges[:-1], len(edges) - 1
                    u, back = np.unique(h1, return_inverse=True)
                    n1 = v[held[at_token : at_token + len(h1)]] if stored else v[f1.levels(u)][back]
                    at_token += len(h1)
                    p1 = (n1 + 1) / denominator
                    c1 = np.maximum(n1, 1)
                    before = np.empty_like(c1)
                    before[1:] = c1[:-1]
                    before[lo] = max(n_docs_trained, 1)
                    c2 = v[f2.levels(h2)]
                    p2 = np.minimum(c2 / np.maximum(before, c2), 1)
                    logs = np.log10(BIGRAM_WEIGHT * p2 + (1 - BIGRAM_WEIGHT) * p1)
                    if n_shards > 1:
                        seg = segment_of(h2, n_segments)
                        logs = np.where((seg >= from_) & (seg < to), logs, 0.0)
                    parts[0].append(np.add.reduceat(logs, lo))
                    if first:
                        signed = u.view(np.int64)
                        at = np.minimum(np.searchsorted(heads, signed), max(len(heads) - 1, 0))
                        known = heads[at] == signed if len(heads) else np.zeros(len(u), bool)
                        c = np.where(known, head_n[at] if len(heads) else 0, 0)
                        sure = known | whole
                        base = np.where(sure, np.log10((c + 1) / denominator), 0.0)
                        parts[1].append(np.diff(edges))
                        parts[2].append(np.add.reduceat(known[back].astype(np.int64), lo))
                        parts[3].append(np.add.reduceat(base[back], lo))
                        tail = np.flatnonzero(~sure[back])
                        of = np.searchsorted(edges, tail, side="right") - 1
                        parts[4].append(np.bincount(of, minlength=n_docs))
                        parts[5].append(h1[tail].view(np.int64))
                cat = lambda i, kind: np.concatenate(parts[i]) if parts[i] else np.zeros(0, kind)
                cols = [batch.column(0), batch.column(1), pa.array(cat(0, np.float64))]
                if first:
                    ends = np.concatenate([[0], np.cumsum(cat(4, np.int64))]).astype(np.int32)
                    cols += [pa.array(cat(1, np.int64)), pa.array(cat(2, np.int64)), pa.array(cat(3, np.float64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(cat(5, np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

        names = ["row", "doc_id", "score"] + (["n_tokens", "head_known", "head_score", "tail"] if first else [])
        schema = "row long, doc_id long, score double" + (", n_tokens long, head_known long, head_score double, tail array<long>" if first else "")
        return keyed.mapInArrow(run, schema)

    out = add_pass(0)
    if n_shards > 1:
        more = [written(add_pass(k).select("row", F.col("score").alias("_more")), "lm-pass") for k in range(1, n_shards)]
        out = out.join(reduce(DataFrame.unionAll, more).groupBy("row").agg(F.sum("_more").alias("_more")), "row").withColumn("score", F.col("score") + F.col("_more")).drop("_more")
    if whole:
        return out.select("doc_id", "n_tokens", F.col("head_known").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), F.col("head_score").alias("base_score"), "score")
    out = written(out, "lm-scored")
    rare = out.select("row", F.explode("tail").alias("h")).groupBy("row", "h").agg(F.count("*").alias("tf")).join(one, "h", "left")
    c = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * F.log10((c + 1) / F.lit(denominator))).alias("more_score"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.drop("tail").join(rare, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("head_known") + zero("more_known")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("head_score") + zero("more_score")).alias("base_score"), "score")


def _held(column: pa.Array) -> np.ndarray:
    """The bytes of all rows one after another."""
    return np.concatenate([np.zeros(0, np.uint8), *(buf for _, _, buf, _ in chunks(column))])


def _unigram_levels(shared):
    """Fills in levels, a byte for each token, from one shard of the unigram filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter(*shared.value)
        for batch in batches:
            found, sizes_ = [np.zeros(0, np.uint8)], [np.zeros(1, np.int64)]
            for _, _, buf, offs in chunks(batch.column(2)):
                h, _, edges = tokens(buf, offs)
                u, back = np.unique(h, return_inverse=True)
                found.append(f.levels(u)[back].view(np.uint8))
                sizes_.append(np.diff(edges))
            new, old = np.concatenate(found), _held(batch.column(3))
            new = np.maximum(new, old) if len(old) else new
            ends = np.cumsum(np.concatenate(sizes_)).astype(np.int32)
            levels = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(new)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], levels], names=["row", "doc_id", "text", "levels"])

    return run

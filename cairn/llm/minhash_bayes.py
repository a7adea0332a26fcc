"""MinHash near-dedup with sequential Bayesian verification.

Each document is the set of its word shingles (64-bit hashes). Documents with
equal sets form a class, and one representative of each class goes on. Banded
MinHash signatures propose pairs of representatives; a pair's signatures are
compared batch by batch, and the pair is given up as soon as the posterior
probability that its similarity reaches the threshold falls below MISS. Pairs
that survive are verified exactly on full sets, and components of the verified
links give each document its group.

Pairs are proposed in two rounds. First each document is paired with the
smallest member of its buckets, and with the largest of their smallest members,
which joins most of a group with two pairs a member. Then only members of one
bucket that are still in different components are paired; all of those, so no
link that a bucket holds is lost, while a large group of near copies, being one
component by then, makes no pairs at all. Buckets of more than FEW members are
compared in pairs of blocks, by signatures first; sets are sent for members that
have a partner left, and only links that join components leave such a task.

Defined results: a null text counts as empty; a text without words has an empty
set and is linked with nothing; with fewer words than a shingle has, the whole
sequence is the one shingle. Rows that share a doc_id count as one document and
are in one group. A row with a null doc_id is linked with nothing, has a null
component and stays. Ties can't arise: ids order the documents. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import dealt_join, fits, map_text, mix, sized_join, word_hashes, word_spans, written

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Similarity threshold in percent; compared in whole numbers.
PERCENT = 80
#: Hashes compared at a time, and the posterior below which a pair is given up.
STEP, MISS = 16, 1e-7
#: Buckets of more than FEW members are compared in blocks of BLOCK, their sets COLUMNS shingles at a time.
FEW, BLOCK, COLUMNS = 32, 512, 4096
WORDS = 5

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """The sorted distinct hashes of a document's word shingles; h: hashes of its words in order."""
    if not len(h):
        return h
    width = min(words, len(h))
    s = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + len(s)]
    return np.unique(mix(s + np.uint64(width)))


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, ((x[i : i + 512, None] ^ _XOR) * _MUL).min(0), out=least)
    return least


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, fp, sig, bands) of docs (doc_id, text): set size, fingerprint of the set, signature, band keys."""

    def run(buf: np.ndarray, offs: np.ndarray) -> list:
        starts, ends, first = word_spans(buf, offs)
        h = word_hashes(buf, starts, ends)
        n, fp, sig, bands = [], [], [], []
        for a, b in zip(first[:-1], first[1:], strict=True):
            s = shingles(h[a:b], words)
            n.append(len(s))
            fp.append(np.array([s.sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64).tobytes() if len(s) else b"")
            if len(s):
                own = signature(s)
                sig.append(own.tobytes())
                k = own.reshape(BANDS, ROWS).astype(np.uint64)
                key = k[:, 0] | (k[:, 1] << np.uint64(32))
                key = mix(mix(key) + (k[:, 2] | (k[:, 3] << np.uint64(32))) + np.arange(BANDS, dtype=np.uint64))
                bands.append(key.view(np.int64))
            else:
                sig.append(b"")
                bands.append([])
        return [pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]

    return map_text(docs.select("doc_id", "text"), "text", [("n", T.LongType()), ("fp", T.BinaryType()), ("sig", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))], run)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each number of compared hashes the fewest matches with which a pair goes on.

    With a uniform prior, matches m of n make the similarity Beta(m + 1, n - m + 1);
    that it reaches t has the probability that n + 1 trials of chance t succeed at most m times.
    """
    t, out = percent / 100, []
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, 0
        for m in range(n + 2):
            p += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if p >= miss:
                break
        out.append(m)
    return out


def survive(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of pairs (rows of signatures a and b) that aren't given up in any batch."""
    alive, m = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        m = m + (a[alive, part] == b[alive, part]).sum(1)
        ok = m >= need
        alive, m = alive[ok], m[ok]
    return alive


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def pruned(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose posterior doesn't fall below MISS."""
    least = least_matches()
    sig = lambda c: reps.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(survive(_sigs(batch.column(2)), _sigs(batch.column(3)), least))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    # a is the smallest member of a bucket and may be in many pairs: its signature is dealt out.
    often = pairs.groupBy("a").agg(F.count("*").alias("n"))
    wide = pairs.join(sig("b"), "b")
    wide = dealt_join(wide, sig("a").join(often, "a"), ["a"], "n", pairs.count(), short=False)
    return wide.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, total: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= PERCENT * (len(s) + len(t) - both):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["a", "b"])

    often = pairs.groupBy("a").agg(F.count("*").alias("n"))
    wide = dealt_join(pairs.join(side("b"), "b"), side("a").join(often, "a"), ["a"], "n", total, short=False)
    return wide.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set): sorted shingle hashes of the documents in ids (id), from their whole texts."""

    def run(buf: np.ndarray, offs: np.ndarray) -> list:
        starts, ends, first = word_spans(buf, offs)
        h = word_hashes(buf, starts, ends)
        return [pa.array([shingles(h[a:b], words).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())]

    rows = sized_join(docs.select(F.col("doc_id").alias("id"), "text"), ids, ["id"], "left_semi")
    return map_text(rows, "text", [("set", T.BinaryType())], run)


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each linked id reaches, by alternating large and small stars.

    Each round sends every id's larger neighbours, then its smaller ones, to the
    smallest neighbour, until the links are stars around the smallest ids.
    """
    stars = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-stars")
    while not are_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "near-min")
        large = dealt_join(both.where("v > u"), near, ["u"], "n", max(1, 2 * stars.count())).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "near-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        stars = written(small.where("u <> v").distinct(), "near-stars")
    return stars.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def are_stars(links: DataFrame) -> bool:
    """Whether each larger end u of links has one smaller end v, which is no larger end itself."""
    twice = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    between = links.select("u").join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return twice.unionByName(between).isEmpty()


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right ones, by products of incidence matrices."""
    ids, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    order = np.argsort(at, kind="stable")
    at, rows = at[order], rows[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(ids), COLUMNS):
        a, b = np.searchsorted(at, [lo, lo + COLUMNS])
        m = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        m[rows[a:b], at[a:b] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def joined_links(ids_a: np.ndarray, comp_a: np.ndarray, ids_b: np.ndarray, comp_b: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """As many of the links (a matrix) as join different components; the others follow from them."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(links)), strict=True):
        a, b = find(int(comp_a[i])), find(int(comp_b[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            x, y = int(ids_a[i]), int(ids_b[j])
            out.append((min(x, y), max(x, y)))
    return out


def _unrefuted(members: DataFrame) -> DataFrame:
    """(band, key, i, j, id, comp): members of large buckets that have a partner in a pair of blocks; members: (band, key, c, id, comp, sig).

    A bucket's members are dealt into blocks, and each pair of blocks is one
    group of 2 * BLOCK members at most, which holds signatures only. A partner is
    of another component and not given up; a pair is looked at in the first band
    that it shares only.
    """
    least = least_matches()
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    mine = members.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", "sig")
    names = ["band", "key", "i", "j", "id", "comp"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band, i, j = (int(pdf[c].iloc[0]) for c in ("band", "i", "j"))
        left, right = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        if not len(left) or not len(right):
            return pdf.iloc[:0][names]
        s, t = (np.frombuffer(b"".join(map(bytes, p["sig"])), np.uint32).reshape(-1, HASHES) for p in (left, right))
        ids_a, ids_b, comp_a, comp_b = (p[c].to_numpy() for c in ("id", "comp") for p in (left, right))
        hit_a, hit_b = np.zeros(len(s), bool), np.zeros(len(t), bool)
        for k in range(len(s)):
            pick = np.flatnonzero((comp_b != comp_a[k]) & ((ids_b > ids_a[k]) if i == j else True))
            if band and len(pick):
                before = (t[pick, : band * ROWS] == s[k, : band * ROWS]).reshape(len(pick), band, ROWS)
                pick = pick[~before.all(2).any(1)]
            if len(pick):
                pick = pick[survive(np.broadcast_to(s[k], (len(pick), HASHES)), t[pick], least)]
                hit_a[k] |= len(pick) > 0
                hit_b[pick] = True
        return pd.concat([left[hit_a], right[hit_b]])[names].drop_duplicates("id")

    return dealt.groupBy("band", "key", "i", "j").applyInPandas(run, "band int, key long, i int, j int, id long, comp long")


def _block_links(members: DataFrame) -> DataFrame:
    """Links (a, b) between components, verified on full sets, in each pair of blocks; members: (band, key, i, j, id, comp, set). What leaves a group is a forest: fewer links than members."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, comp = pdf["id"].to_numpy(), pdf["comp"].to_numpy()
        sets = [np.frombuffer(bytes(x), np.uint64) for x in pdf["set"]]
        sizes = np.array([len(x) for x in sets])
        both = common_counts(sets, sets)
        alike = (100 * both >= PERCENT * (sizes[:, None] + sizes - both)) & (comp[:, None] != comp) & (ids[:, None] < ids)
        return pd.DataFrame(joined_links(ids, comp, ids, comp, alike), columns=["a", "b"], dtype="int64")

    return members.groupBy("band", "key", "i", "j").applyInPandas(run, "a long, b long")


def grouped(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    sketch = written(sketched(docs, words), "near-sketch")
    real = sketch.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(real.groupBy("n", "fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "near-classes")
    reps = dealt_join(real.select(F.col("doc_id").alias("own"), "n", "fp", "sig", "bands"), classes, ["n", "fp"], "copies", real.count()).where("own = id").select("id", "n", "sig", "bands").dropDuplicates(["id", "sig"])
    reps = written(reps, "near-reps")

    banded = reps.select("id", "n", F.posexplode("bands").alias("band", "key"))
    buckets = written(banded.groupBy("band", "key").agg(F.min("id").alias("lead"), F.count("*").alias("c")).where("c > 1"), "near-buckets")
    total = max(1, reps.count() * BANDS)
    members = written(dealt_join(banded, buckets, ["band", "key"], "c", total), "near-members")

    leads = members.where("id <> lead").groupBy("id").agg(F.min("lead").alias("x"), F.max("lead").alias("y"))
    star = written(leads.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), F.col("id").alias("b")), "near-pairs")
    kept = written(pruned(star, reps), "near-survivors")
    sets = written(full_sets(docs, kept.select(F.explode(F.array("a", "b")).alias("id")).distinct(), words), "near-sets")
    links = written(verified(kept, sets, max(1, kept.count())), "near-links")
    comps = components(links)

    # Second round: pairs of a bucket that are still in different components and not refuted.
    labelled = members.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    labelled = written(labelled, "near-labelled")
    mixed = labelled.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "key")
    open_ = written(labelled.join(mixed, ["band", "key"]), "near-open")
    few, many = open_.where(F.col("c") <= FEW), open_.where(F.col("c") > FEW)
    right = few.select("band", "key", F.col("id").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"))
    pairs = few.select("band", "key", F.col("id").alias("a"), "comp", "n").join(right, ["band", "key"])
    alike = (100 * F.least("n", "n_b") >= PERCENT * F.greatest("n", "n_b")) & (F.col("comp") != F.col("comp_b")) & (F.col("a") < F.col("b"))
    pairs = pairs.where(alike).select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    rest = written(pruned(written(pairs, "near-pairs2"), reps), "near-survivors2")
    blocked = written(_unrefuted(many.join(reps.select("id", "sig"), "id")), "near-blocked")
    wanted = rest.select(F.explode(F.array("a", "b")).alias("id")).union(blocked.select("id")).distinct()
    if not wanted.isEmpty():
        sets2 = written(full_sets(docs, wanted, words), "near-sets2")
        more = verified(rest, sets2, max(1, rest.count())).unionByName(_block_links(blocked.join(sets2, "id")))
        more = written(more, "near-links2")
        if not more.isEmpty():
            comps = components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more))

    placed = classes.join(comps, "id", "left").select("n", "fp", "copies", F.coalesce("comp", "id").alias("component_id"))
    placed = written(placed, "near-placed")
    linked = dealt_join(real.select("doc_id", "n", "fp"), placed, ["n", "fp"], "copies", real.count()).select("doc_id", "n", "component_id")
    alone = sketch.where("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def kept_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    gone = written(grouped(docs, words).where("NOT kept").select("doc_id").distinct(), "near-gone")
    return docs.join(F.broadcast(gone) if fits(gone) else gone, "doc_id", "left_anti").select(*docs.columns)

"""SimHash near-dedup by multi-index hashing.

A text's fingerprint has a bit for each of 64 majority votes of its shingles'
hashes. Fingerprints are indexed by each of their two halves. If two differ in
two bits at most, either their first halves differ in one bit at most, or their
second halves are equal: so a fingerprint asks the first table for the ball of
radius one around its first half, and the second table for its second half, and
what it finds is verified by the distance of whole fingerprints. A pair that
differs in one bit of the first half is asked for by the fingerprint that lacks
the bit only.

Only distinct fingerprints are indexed. A slot of a table with more than FEW of
them is not paired out: all fingerprints that hold or ask such a slot are dealt
by the 65 points of the ball of radius one around them. Two share a point exactly
if they differ in two bits at most, at most 65 share one, and all of those are
linked with the smallest, so a large group of near copies gives a bounded number
of rows for each member, and no link between components is lost.

Defined results: a null text counts as empty; a text without words has the
fingerprint zero, and is linked like any other; with fewer words than a shingle
has, the whole sequence is the one shingle. A row with a null doc_id has its
fingerprint and a null component, and links nothing. Rows are taken one by one:
repeated doc_ids with different texts may be in different components. Ties can't
arise: a bit is set by more than half of the hashes only. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import IS_SPACE, LOWER, dealt_join, map_text, sized_join, word_spans, written
from cairn.llm.minhash_bayes import components

WORDS, SEED = 3, 42
#: Bits in which linked fingerprints may differ; the tables and balls below are made for this number.
DISTANCE = 2
#: Slots with more fingerprints are dealt by the points around them.
FEW = 16
#: Shingles that are hashed at a time.
BLOCK = 1 << 15


def single_spaced(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with A-Z lower-cased and one space for each run of white space, and the new offsets."""
    space = IS_SPACE[buf]
    first = np.zeros(len(buf), bool)  # a text's first byte follows nothing
    first[offs[:-1][offs[1:] > offs[:-1]]] = True
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1] & ~first[1:]
    out = LOWER[buf]
    out[space] = 0x20
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def votes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each bit, highest first, how many of the shingles' hashes have it."""
    hashed = xxhash.xxh64_digest
    total = np.zeros(64, np.int64)
    for lo in range(0, len(starts), BLOCK):
        h = b"".join([hashed(data[s:e], SEED) for s, e in zip(starts[lo : lo + BLOCK].tolist(), ends[lo : lo + BLOCK].tolist(), strict=True)])
        total += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return total


def fingerprints(buf: np.ndarray, offs: np.ndarray, words: int) -> np.ndarray:
    text, at = single_spaced(buf, offs)
    starts, ends, first = word_spans(text, at)
    data = text.tobytes()
    bits = np.zeros((len(offs) - 1, 64), bool)
    for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if a < b:
            width = min(words, b - a)
            n = b - a - width + 1
            bits[d] = 2 * votes(data, starts[a : a + n], ends[a + width - 1 : b]) > n
    return np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel()


def printed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text): fingerprints as longs."""
    return map_text(docs.select("doc_id", "text"), "text", [("fp", T.LongType())], lambda buf, offs: [fingerprints(buf, offs, words)])


def near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(0xFFFFFFFF)


def table(prints: DataFrame) -> DataFrame:
    """(half, slot, fp): where distinct fingerprints (fp) are found."""
    slots = [F.struct(F.lit(k).alias("half"), h.alias("slot")) for k, h in enumerate(halves(F.col("fp")))]
    return prints.select("fp", F.inline(F.array(*slots))).select("half", "slot", "fp")


def probes(prints: DataFrame) -> DataFrame:
    """(half, slot, asks): the slots that fingerprints ask for: around the first half those with one bit more, and both halves themselves."""
    one, two = halves(F.col("fp"))
    more = [F.when(one.bitwiseAND(1 << i) == 0, F.struct(F.lit(0).alias("half"), one.bitwiseOR(F.lit(1 << i).cast("long")).alias("slot"))) for i in range(32)]
    own = [F.struct(F.lit(k).alias("half"), h.alias("slot")) for k, h in enumerate((one, two))]
    return prints.select(F.col("fp").alias("asks"), F.inline(F.array_compact(F.array(*own, *more)))).select("half", "slot", "asks")


def crowded_links(prints: DataFrame) -> DataFrame:
    """(a, b): each fingerprint linked with the smallest of those that share a point of the balls of radius one around them."""
    around = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.expr(f"shiftleft(1L, {i})")) for i in range(64)]]
    points = prints.select("fp", F.explode(F.array(*around)).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    return points.join(least, "point").where("a <> fp").select("a", F.col("fp").alias("b"))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that join those that reach each other."""
    held, asked = table(prints), probes(prints)
    large = written(held.groupBy("half", "slot").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("half", "slot"), "simhash-large")
    touch = held.withColumnRenamed("fp", "asks").unionByName(asked)
    crowded = written(sized_join(touch, large, ["half", "slot"], "left_semi").select(F.col("asks").alias("fp")).distinct(), "simhash-crowded")
    few = sized_join(held, large, ["half", "slot"], "left_anti")
    pairs = asked.join(few, ["half", "slot"]).where(near("asks", "fp") & (F.col("asks") != F.col("fp"))).select(F.least("asks", "fp").alias("a"), F.greatest("asks", "fp").alias("b"))
    return pairs.unionByName(crowded_links(crowded).where(near("a", "b"))).distinct()


def grouped(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text)."""
    prints = written(printed(docs, words), "simhash-prints")
    named = prints.where("doc_id IS NOT NULL")
    classes = written(named.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "simhash-classes")
    found = written(links(classes.select("fp")), "simhash-links")
    comps = written(components(found).select(F.col("id").alias("fp"), "comp"), "simhash-components")
    # The smallest doc_id of a component, over its fingerprints; only of those that are linked.
    linked = written(classes.join(comps.unionByName(comps.select(F.col("comp").alias("fp"), "comp").distinct()), "fp"), "simhash-linked")
    least = written(linked.groupBy("comp").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "simhash-least")
    of = dealt_join(linked.select("fp", "comp"), least, ["comp"], "n", max(1, linked.count())).select("fp", "component_id")
    placed = written(classes.join(of, "fp", "left").select("fp", "copies", F.coalesce("component_id", "id").alias("component_id")), "simhash-placed")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    out = dealt_join(named, placed, ["fp"], "copies", max(1, named.count())).select("doc_id", shown, "component_id")
    nameless = prints.where("doc_id IS NULL").select("doc_id", shown, F.col("doc_id").alias("component_id"))
    return out.unionByName(nameless)

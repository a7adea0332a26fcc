"""Fuzzy hashes of texts by context-triggered pieces, and a search for texts with like hashes.

A rolling sum over seven bytes says where a piece ends; each piece gives one
character, so an edit changes the characters of the pieces around it only. The
length of pieces doubles with that of texts, and a hash holds the pieces of two
lengths, so that texts of somewhat different length can be compared. All rolling
sums of a text are computed at once, and all pieces of many texts side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.texts import collapsed

#: Window of the rolling sum, least length of pieces, most characters of either hash, characters, and start and factor of a piece's hash (its six lowest bits). Fixed values.
WINDOW, LEAST, LONG, SHORT = 7, 3, 64, 32
CHARACTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
START, FACTOR = 0x28021967 & 63, 0x01000193 & 63
#: Bytes of texts whose pieces are hashed side by side; a longer text is taken alone.
GROUP = 1 << 20
#: Letters in a row of which two hashes must share one to be compared.
GRAM = 7

FUZZY = "struct<size:int,first:string,second:string>"


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling sum at each byte: the window's bytes, the same weighted by their age, and the same shifted and mixed."""
    c = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    plain, weighted, mixed = (np.zeros(len(data), np.uint32) for _ in range(3))
    for age in range(WINDOW):
        x = c[WINDOW - 1 - age : len(c) - age]
        plain += x
        weighted += np.uint32(WINDOW - age) * x
        mixed ^= x << np.uint32(5 * age)
    return plain + weighted + mixed


def ends(roll: np.ndarray, size: int, most: int) -> np.ndarray:
    """Offsets behind the pieces of a length; what follows the last of them is one more piece."""
    return np.flatnonzero(roll % np.uint32(size) == size - 1)[: most - 1] + 1


def cuts(data: np.ndarray) -> tuple[int, list[np.ndarray], bool]:
    """(length, ends of the pieces of that length and of twice it, whether what is left gives a character)."""
    roll, size = rolling(data), LEAST
    while size * LONG < len(data):
        size *= 2
    while size > LEAST and len(ends(roll, size, LONG)) < LONG // 2:
        size //= 2
    return size, [ends(roll, size, LONG), ends(roll, 2 * size, SHORT)], bool(len(roll) and roll[-1])


def piece_characters(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A character for each piece; all pieces go on by one byte at a time."""
    order = np.argsort(starts - stops, kind="stable")
    begin, length = starts[order], (stops - starts)[order]
    h = np.full(len(order), START, np.uint8)
    alive = len(order)
    for step in range(int(length[0]) if alive else 0):
        alive = int(np.searchsorted(-length[:alive], -step, side="left"))  # longer than step
        h[:alive] = (h[:alive] * np.uint8(FACTOR) ^ data[begin[:alive] + step]) & np.uint8(63)
    out = np.empty(len(order), np.uint8)
    out[order] = CHARACTERS[h]
    return out


def fuzzy_hashes_of(texts: list[bytes]) -> list[dict]:
    found, starts, stops, base = [], [], [], 0
    for text in texts:
        size, both, rest = cuts(np.frombuffer(text, np.uint8))
        for own in both:
            edges = np.concatenate([[0], own, [len(text)] if rest else []]).astype(np.int64) + base
            starts.append(edges[:-1])
            stops.append(edges[1:])
        found.append(size)
        base += len(text)
    if not found:
        return []
    letters = piece_characters(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(starts), np.concatenate(stops)).tobytes().decode()
    at = np.concatenate([[0], np.cumsum([len(s) for s in starts])]).tolist()
    cut = [letters[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return [{"size": size, "first": cut[2 * i], "second": cut[2 * i + 1]} for i, size in enumerate(found)]


def _groups(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > GROUP:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def canonical(text: Column) -> Column:
    """A text as its fuzzy hash takes it: lower-cased, white space collapsed."""
    return F.lower(collapsed(F.coalesce(text, F.lit(""))))


def with_fuzzy(df: DataFrame, column: str, name: str = "fuzzy") -> DataFrame:
    """df without column, with the fuzzy hash of its texts; null counts as empty."""
    kept = [f for f in df.schema.fields if f.name != column]
    source = df.withColumn(column, canonical(F.col(column)).cast("binary"))
    kind = pa.struct([("size", pa.int32()), ("first", pa.string()), ("second", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            made = [x for group in _groups(v.as_py() for v in values) for x in fuzzy_hashes_of(group)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], pa.array(made, kind)], names=[*[f.name for f in kept], name])

    return source.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL(f"`{name}` {FUZZY}").fields]))


def shown(fuzzy: Column) -> Column:
    """size:first:second."""
    return F.concat_ws(":", fuzzy["size"].cast("string"), fuzzy["first"], fuzzy["second"])


def _pieces(hashes: DataFrame, key: str) -> DataFrame:
    """(key, size, piece, gram): both hashes of each row with the letter sequences in them; runs of more than three equal letters are cut to three."""
    one = lambda size, text: F.struct(size.alias("size"), F.regexp_replace(text, r"(.)\1{3,}", "$1$1$1").alias("piece"))
    f = F.col("fuzzy")
    both = hashes.select(key, F.inline(F.array(one(f["size"], f["first"]), one(f["size"] * 2, f["second"]))))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("piece") - GRAM + 1, F.lit(1))), lambda i: F.substring(F.col("piece"), i, F.lit(GRAM))))
    return both.select(key, "size", "piece", F.explode(grams).alias("gram"))


def likeness(a: Column, b: Column) -> Column:
    """100 for equal hashes, less for each letter that must be changed to get from one to the other."""
    return F.floor(100 - 100 * F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))).cast("int")


def alike(hashes: DataFrame, wanted: DataFrame, key: str, least: int = 60) -> DataFrame:
    """(wanted, key, score): rows of hashes (key, fuzzy) that are like one of wanted (key, fuzzy), itself excepted.

    Rows meet by a shared letter sequence of pieces of equal length. Equal hashes
    are one row until the end, so copies aren't compared again and again.
    """
    same = F.xxhash64("fuzzy").alias("class")
    classes = hashes.select(key, same, "fuzzy")
    asked = wanted.select(F.col(key).alias("wanted"), same, "fuzzy")
    one = lambda df: _pieces(df.select("class", "fuzzy").dropDuplicates(["class"]), "class")
    right = one(classes).select(F.col("class").alias("found"), "size", F.col("piece").alias("other"), "gram")
    pairs = one(asked).join(right, ["size", "gram"]).select("class", "found", "piece", "other").distinct()
    scores = pairs.groupBy("class", "found").agg(F.max(likeness(F.col("piece"), F.col("other"))).alias("score")).where(F.col("score") >= least)
    out = asked.select("wanted", "class").join(scores, "class").join(classes.select(key, F.col("class").alias("found")), "found")
    return out.where(F.col("wanted") != F.col(key)).select("wanted", key, "score")

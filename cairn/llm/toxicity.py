"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is read in windows of WINDOW words. The words of a window and their
character n-grams, bounded by the spaces around them, are hashed to buckets;
their embeddings are averaged and a linear softmax over two classes gives the
window's probability. The evidence of a run of windows is minus the logarithm of
the product of their clean probabilities, less LEAK for each window: what clean
text gives by its length alone. A text's score is that of its strongest span of
SPAN windows, less CHANCE for each factor of e in the number of spans, of which
the strongest grows by chance; so a long clean text scores as low as a short one,
and a toxic passage counts wherever it stands. Embeddings and softmax are
trained together in numpy from document labels; a misspelt word shares most of
its n-grams with the word, seen or not.

Defined results: null text counts as empty, an empty text has no window and
gets the score of none (0); a null doc_id is never held out or used for
training; null or contradicting labels are left out; without training rows all
scores are 0. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import IS_SPACE, LOWER, chunks, fresh, map_text, sample, word_hashes, word_spans

WINDOW, ORDERS, BUCKETS, WIDTH = 4, (4, 5, 6), 1 << 18, 8
#: Bound of the training sample: documents of either label, and bytes of all of them; documents are taken whole.
SAMPLE_EACH, SAMPLE_BYTES = 1500, 1500 * 8192
EPOCHS, PARTS, RATE, SEED = 16, 12, 0.3, 5
LEAK, SPAN, CHANCE = 1e-3, 512, 2.0
THRESHOLD = 0.7


def spaced(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space before each and after the last, lower-cased, and the new offsets."""
    n = len(offs) - 1
    out = np.full(len(buf) + n + 1, 0x20, np.uint8)
    out[np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), np.diff(offs))] = LOWER[buf]
    out[IS_SPACE[out]] = 0x20
    return out, offs + np.arange(n + 1) + 1


def subwords(buf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the positions of n-grams with no space inside, and their buckets."""
    space = np.concatenate([[0], np.cumsum(buf == 0x20, dtype=np.int32)])
    wide, out, h = buf.astype(np.uint32), [], np.zeros(len(buf), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        m = len(buf) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) ^ wide[n - 1 :]
        if n in ORDERS:
            at = np.flatnonzero(space[n - 1 : n - 1 + m] == space[1 : m + 1])
            x = h[at] * np.uint32(0x9E3779B1)
            out.append((at, ((x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32)))
    return out


def windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(byte before each window, first window of each document, word starts, parts): parts hold (positions, buckets)."""
    text, at = spaced(buf, offs)
    starts, ends, first = word_spans(text, np.concatenate([at[:-1], [len(text)]]))
    n_words = np.diff(first)
    n_win = -(-n_words // WINDOW)
    edges = np.concatenate([[0], np.cumsum(n_win)])
    doc_of = np.repeat(np.arange(len(n_win)), n_win)
    begin = starts[first[doc_of] + (np.arange(edges[-1]) - edges[doc_of]) * WINDOW] - 1 if edges[-1] else np.zeros(0, np.int64)
    parts = subwords(text)
    if len(starts):
        parts.append((starts - 1, (word_hashes(text, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int32)))
    return begin, edges, text, parts


@dataclass
class Model:
    table: np.ndarray  # softmax margin of each bucket's embedding
    bias: float

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        begin, edges, text, parts = windows(buf, offs)
        if not len(begin):
            return np.zeros(len(offs) - 1)
        total, count = np.zeros(len(text)), np.zeros(len(text), np.int32)
        for at, ids in parts:
            total[at] += self.table[ids]
            count[at] += 1
        z = np.add.reduceat(total, begin) / np.maximum(np.add.reduceat(count, begin), 1) + self.bias
        return toxic(z, edges)


def evidence(z: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For runs of windows: minus the logarithm of the probability that all are clean, less what their number gives by itself."""
    clean = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, z))])
    return clean[ends] - clean[starts] - LEAK * (ends - starts)


def toxic(z: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Scores of texts from their windows' margins: of the strongest span, with a bias for the number of spans."""
    n = -(-np.diff(edges) // SPAN)
    first = np.concatenate([[0], np.cumsum(n)])
    of = np.repeat(np.arange(len(n)), n)
    starts = edges[of] + (np.arange(len(of)) - first[of]) * SPAN
    spans = evidence(z, starts, np.minimum(starts + SPAN, edges[of + 1]))
    out = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.maximum.reduceat(spans, first[full]) - CHANCE * np.log(n[full])
    return -np.expm1(-np.maximum(out, 0))


def train(texts: list[bytes], y: np.ndarray, seed: int = SEED) -> Model:
    """Adagrad on the cross-entropy of documents; toxic ones must reach what the number of their spans will cost them."""
    rng = np.random.default_rng(seed)
    batches = []
    deal = rng.permutation(len(texts))
    for k in range(PARTS):
        own = deal[k::PARTS]
        if not len(own):
            continue
        (_, _, buf, offs), *_ = chunks(pa.array([texts[i] for i in own], pa.large_binary()), 1 << 40)
        begin, edges, text, parts = windows(buf, offs)
        if len(begin):
            at, ids = np.concatenate([p for p, _ in parts]), np.concatenate([b for _, b in parts])
            of = (np.searchsorted(begin, at, side="right") - 1).astype(np.int32)
            used, ids = np.unique(ids, return_inverse=True)
            batches.append((used, ids.astype(np.int32), of, np.maximum(np.bincount(of, minlength=len(begin)), 1), edges, y[own]))
    table, soft = rng.normal(0, 0.5 / WIDTH, (BUCKETS, WIDTH)), rng.normal(0, 1, (WIDTH, 2))
    bias, seen, seen_soft, seen_bias = np.array([0.0, -5.0]), np.full((BUCKETS, 1), 1e-8), np.full((WIDTH, 2), 1e-8), 1e-8
    for _ in range(EPOCHS):
        for used, ids, of, n, edges, yb in batches:
            margin, own = soft[:, 1] - soft[:, 0], table[used]
            z = np.bincount(of, weights=(own @ margin)[ids], minlength=len(n)) / n + bias[1] - bias[0]
            s = evidence(z, edges[:-1], edges[1:]) - np.where(yb == 1, CHANCE * np.log(np.maximum(-(-np.diff(edges) // SPAN), 1)), 0)
            p = np.clip(-np.expm1(-np.maximum(s, 1e-4)), 1e-9, 1 - 1e-9)
            # d loss / d z of a window: its own probability, times 1 for a clean text that has evidence, -(1-p)/p for a toxic one
            by_doc = np.where(yb == 1, np.maximum(-(1 - p) / p, -20), s > 0) / len(yb)
            dz = np.repeat(by_doc, np.diff(edges)) / (1 + np.exp(-z))
            c = np.bincount(ids, weights=(dz / n)[of], minlength=len(used))
            d_table, d_margin = c[:, None] * margin, c @ own
            seen[used, 0] += (d_table**2).mean(1)
            table[used] -= RATE * d_table / np.sqrt(seen[used])
            d_soft = np.stack([-d_margin, d_margin], axis=1)
            seen_soft += d_soft**2
            soft -= 0.3 * RATE * d_soft / np.sqrt(seen_soft)
            seen_bias += dz.sum() ** 2
            bias += 0.1 * RATE * dz.sum() / np.sqrt(seen_bias) * np.array([1, -1])
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic") -> Model | None:
    """A model of label from rows of labels for which usable holds, or None without any."""
    rows = sample(docs, labels, label, usable, SAMPLE_EACH, SAMPLE_BYTES, by_class=True)
    found = sorted(rows.select("doc_id", "y", F.col("text").cast("binary").alias("x")).collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    if not found:
        return None
    return train([bytes(r.x) for r in found], np.array([r.y for r in found]))


def scored(docs: DataFrame, model: Model | None, drop_text: bool = False, name: str = "score") -> DataFrame:
    """docs with the column name, which gets underscores in front if docs has one of that name."""
    name = fresh(docs, name)
    if model is None:
        out = docs.withColumn(name, F.lit(0.0))
        return out.drop("text") if drop_text else out
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.table, model.bias))  # BUCKETS floats: 1 MB at any size of input

    def run(buf: np.ndarray, offs: np.ndarray) -> list:
        return [Model(*shared.value).score(buf, offs)]

    return map_text(docs, "text", [(name, T.DoubleType())], run, drop_text)

"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is described by
how its characters follow one another (counts of pairs of character classes)
and by how its words repeat, and encoded by a learned layer. Gated attention
weighs the encoded passages, and the weighted mean gives the document's
probability. Only document labels are used; encoder, attention and output are
trained together in numpy on a bounded sample of labelled documents.

Defined results: a null text counts as empty; an empty text is one passage of
zeros and gets a score; a null doc_id is never held out and never used for
training; labels that are null, or contradict each other for a document, are
left out. Without training rows the score is 0.5; with one class only, the
model still trains and says that class. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import fresh, map_text, sample, word_hashes, word_spans

PASSAGE = 128
#: Bound of the training sample: documents, and bytes of all of them; documents are taken whole, with all their passages.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 24 << 20
ENCODED, GATE, EPOCHS, BATCH, RATE, SEED = 32, 16, 30, 64, 0.004, 11
THRESHOLD = 0.3

_KINDS = 16
_CLASS = np.full(256, 13, np.uint8)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".,;:", b"!?", b"#", b"*", b"$%&", b"|", b"<>")):
    _CLASS[list(_bytes)] = _k
_CLASS[0xC0:] = 14
_CLASS[0x80:0xC0] = 15
N_DENSE = 5
N_FEATURES = _KINDS * _KINDS + N_DENSE


def passages(buf: np.ndarray, offs: np.ndarray, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and each document's first passage (one more at the end)."""
    starts, ends, first = word_spans(buf, offs)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // size))
    edges = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(edges[-1])
    dense = np.zeros((total, N_DENSE), np.float32)
    pairs = np.zeros((total, _KINDS * _KINDS), np.float32)
    if len(starts):
        doc_of = np.repeat(np.arange(len(n_words)), n_words)
        within = np.arange(len(starts)) - first[doc_of]
        passage = edges[doc_of] + within // size
        # Bytes belong to the passage of the word at or before them.
        cuts = starts[np.flatnonzero(np.diff(passage, prepend=-1))]
        of_byte = np.zeros(len(buf), np.int64)
        of_byte[cuts] = np.diff(passage[np.searchsorted(starts, cuts)], prepend=0)
        of_byte = np.cumsum(of_byte)
        kind = _CLASS[buf].astype(np.int64)
        same = of_byte[1:] == of_byte[:-1]
        code = (of_byte[:-1] * _KINDS + kind[:-1]) * _KINDS + kind[1:]
        pairs = np.bincount(code[same], minlength=total * _KINDS * _KINDS).reshape(total, -1).astype(np.float32)
        words = np.bincount(passage, minlength=total)
        least = np.maximum(words, 1)
        h = word_hashes(buf, starts, ends)
        long = ends - starts >= 5
        key = (doc_of.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
        order = np.argsort(key, kind="stable")
        seen = np.zeros(len(h), bool)
        seen[order[1:]] = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[1:] = key[1:] == key[:-1]
        n_long = np.maximum(np.bincount(passage[long], minlength=total), 1)
        dense[:, 0] = np.bincount(passage[seen & long], minlength=total) / n_long
        dense[:, 1] = np.bincount(passage[twice], minlength=total) / least
        dense[:, 2] = np.minimum(np.bincount(passage, weights=ends - starts, minlength=total) / least / 16, 2)
        dense[:, 3] = np.log1p(words) / np.log1p(size)
        dense[:, 4] = np.log1p(np.repeat(n_words, n_pass)) / 10
    mass = np.maximum(pairs.sum(1, keepdims=True), 1)
    return np.concatenate([np.sqrt(pairs / mass), dense], axis=1).astype(np.float32), edges


@dataclass
class Model:
    w: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        h = np.tanh(x @ w["We"] + w["be"])
        t, g = np.tanh(h @ w["Wt"]), 1 / (1 + np.exp(-(h @ w["Wg"])))
        e = (t * g) @ w["v"]
        lo, n = edges[:-1], np.diff(edges)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, lo), n))
        a = e / np.repeat(np.add.reduceat(e, lo), n)
        z = np.add.reduceat(a[:, None] * h, lo, axis=0)
        p = 1 / (1 + np.exp(-(z @ w["u"] + w["c"])))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p}

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x, edges = passages(buf, offs)
        return self.bags(x, edges)["p"].astype(np.float64)


def train(x: np.ndarray, edges: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the mean cross-entropy of bags; y: 0 or 1 for each."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    w = {
        "We": rng.normal(0, d**-0.5, (d, ENCODED)), "be": np.zeros(ENCODED), "Wt": rng.normal(0, ENCODED**-0.5, (ENCODED, GATE)), "Wg": rng.normal(0, ENCODED**-0.5, (ENCODED, GATE)),
        "v": rng.normal(0, GATE**-0.5, GATE), "u": rng.normal(0, ENCODED**-0.5, ENCODED), "c": np.array(np.log(rate / (1 - rate))),
    }
    model, m, s, step = Model(w), {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    sizes = np.diff(edges)
    for _ in range(epochs):
        deal = rng.permutation(len(y))
        for k in range(0, len(deal), BATCH):
            pick = deal[k : k + BATCH]
            n = sizes[pick]
            own = np.concatenate([[0], np.cumsum(n)])
            xb = x[np.repeat(edges[pick] - own[:-1], n) + np.arange(own[-1])]
            f = model.bags(xb, own)
            dp = (f["p"] - y[pick]) / len(pick)
            dz = np.repeat(dp[:, None] * w["u"], n, axis=0)
            da = (dz * f["h"]).sum(1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, own[:-1]), n))
            dtg = de[:, None] * w["v"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            dh = (f["a"][:, None] * dz + dt @ w["Wt"].T + dg @ w["Wg"].T) * (1 - f["h"] ** 2)
            grad = {"We": xb.T @ dh + 1e-5 * w["We"], "be": dh.sum(0), "Wt": f["h"].T @ dt, "Wg": f["h"].T @ dg, "v": (f["t"] * f["g"]).T @ de, "u": f["z"].T @ dp + 1e-5 * w["u"], "c": dp.sum()}
            step += 1
            for key, g in grad.items():
                m[key] = 0.9 * m[key] + 0.1 * g
                s[key] = 0.999 * s[key] + 0.001 * g * g
                w[key] -= RATE * (m[key] / (1 - 0.9**step)) / (np.sqrt(s[key] / (1 - 0.999**step)) + 1e-8)
    model.w = {k: v.astype(np.float32) for k, v in w.items()}
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Model | None:
    """A model of label from rows of labels for which usable holds, or None without any."""
    rows = sample(docs, labels, label, usable, SAMPLE_DOCS, SAMPLE_BYTES, by_class=False)

    def features(buf: np.ndarray, offs: np.ndarray) -> list:
        x, edges = passages(buf, offs)
        return [[x[i:j].astype(np.float16).tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]]

    found = sorted(map_text(rows, "text", [("x", T.BinaryType())], features).collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    if not found:
        return None
    bags = [np.frombuffer(bytes(r.x), np.float16).reshape(-1, N_FEATURES) for r in found]
    edges = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return train(np.concatenate(bags).astype(np.float32), edges, np.array([r.y for r in found], float))


def scored(docs: DataFrame, model: Model | None, drop_text: bool = False, name: str = "score") -> DataFrame:
    """docs with the column name, which gets underscores in front if docs has one of that name."""
    name = fresh(docs, name)
    if model is None:
        out = docs.withColumn(name, F.lit(0.5))
        return out.drop("text") if drop_text else out
    return map_text(docs, "text", [(name, T.DoubleType())], lambda buf, offs: [model.score(buf, offs)], drop_text)

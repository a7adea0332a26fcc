"""Embedding whitening by TSQR.

Entries become whole numbers, so the sums of all dimensions are exact and every
row is centred without rounding. Each task folds its centred rows into one
triangular factor R; factors are stacked and factored again in groups of FAN, in
a tree, until one is left. Its singular values and right vectors are those of
the whole centred matrix: they whiten rows, and a covariance is never formed. The
same tree over the whitened rows gives a factor from which the distance of their
covariance from the identity is read.

What reaches the driver are sums and one factor: d and d x d numbers for vectors
of d entries, whatever the number of rows.

Defined results: rows whose vector is null, or has a null or non-finite entry or
one whose whole number doesn't fit a long, are left out. The dimension is the
length that most of the others have (of two, the larger); vectors of other
lengths, empty ones among them, are left out too. Repeated rows and null vec_ids
count like others. A deviation that doesn't fit a long is null. Components whose
variance is lost in rounding (as in constant or dependent dimensions) have
whitened null, and identity_error is about the others; without any it is 0, and
explained is 0 where all vectors are equal. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cairn.llm.common import bounded_batches, temporary_tables, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Factors that are stacked at a time; rows that are folded in or sent on at a time.
FAN, ROWS = 16, 2048


def whole(column: pa.Array, d: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable rows, their lengths, whole numbers of those of length d) of a column of vectors; without d no numbers."""
    offs = column.offsets.to_numpy().astype(np.int64)
    c = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * c)
    odd = np.concatenate([[0], np.cumsum(~(np.abs(scaled) < 2.0**63 - 2 * SHIFT))])
    n = np.diff(offs)
    good = column.is_valid().to_numpy(zero_copy_only=False) & (odd[offs[1:]] == odd[offs[:-1]]) & (n > 0)
    if d is None:
        return np.flatnonzero(good), n[good], np.zeros((0, 0), np.int64)
    rows = np.flatnonzero(good & (n == d))
    return rows, n[rows], scaled[offs[rows][:, None] + np.arange(d)].astype(np.int64) + SHIFT


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns of 64-bit numbers, by halves of 32 bits, for up to 2^31 rows."""
    high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
    return [(int(h) << 32) + int(s) for h, s in zip(high, low, strict=True)]


def blocks(column: pa.Array) -> Iterator[pa.Array]:
    for lo in range(0, len(column), ROWS):
        yield column.slice(lo, ROWS)


@dataclass
class Fit:
    """n vectors of d entries with exact sums; directions: d x k right vectors divided by standard deviations, null components 0."""

    n: int
    sums: list[int]
    directions: np.ndarray | None = None
    explained: np.ndarray | None = None
    known: np.ndarray | None = None
    identity_error: float = 0.0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly; as Python's numbers where 64 bits are too few."""
        most = self.n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, self.sums))
        if most < 1 << 62:
            return self.n * x - np.array(self.sums)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.lifted(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = self.lifted(x)
        most = int(max(abs(y.max(initial=0)), abs(y.min(initial=0))))
        if most * most * y.shape[1] < 1 << 63:
            return (y * y).sum(1).astype(np.int64).tolist()
        return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in row) for row in y)]


def sums(vectors: DataFrame) -> Fit | None:
    """The number of vectors of the dimension, and their sums; vectors: (vec_id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for part in blocks(batch.column(0)):
                _, lengths, _ = whole(part)
                for d in np.unique(lengths).tolist():
                    _, _, x = whole(part, d)
                    n, old = found.get(d, (0, [0] * d))
                    found[d] = n + len(x), [a + b for a, b in zip(old, exact_sums(x), strict=True)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([list(map(Decimal, s)) for _, s in found.values()], pa.list_(pa.decimal128(38, 0)))], names=["d", "n", "sums"])

    tasks = written(vectors.select("embedding").mapInArrow(run, "d int, n long, sums array<decimal(38,0)>"), "whiten-sums")
    dims = tasks.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not dims:
        return None
    d = dims[0].d
    total = tasks.where(F.col("d") == d).agg(F.array(*[F.sum(F.col("sums")[i]).cast("decimal(38,0)") for i in range(d)])).collect()[0][0]
    return Fit(dims[0].n, [int(s) for s in total])


def folded(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows below the factor r."""
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def tree_factor(vectors: DataFrame, fit: Fit, project: bool) -> np.ndarray:
    """The triangular factor of all centred rows, or of all whitened ones with project: a factor for each task, merged FAN at a time."""
    d = len(fit.sums)
    schema = "id long, width int, r binary"

    def packed(ids: list[int], r: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"id": ids, "width": np.int32(r.shape[1]), "r": [r.tobytes()]})

    def leaf(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, at = None, 0
        for batch in frames:
            at = batch.column(1)[0].as_py() if batch.num_rows else at
            for part in blocks(batch.column(0)):
                _, _, x = whole(part, d)
                if len(x):
                    y = fit.centred(x)
                    r = folded(r, y @ fit.directions if project else y)
        if r is not None:
            yield pa.RecordBatch.from_pandas(packed([at], r), schema=pa.schema([("id", pa.int64()), ("width", pa.int32()), ("r", pa.binary())]))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        r = None
        frame = frame.sort_values("id")
        for raw, width in zip(frame["r"], frame["width"], strict=True):
            r = folded(r, np.frombuffer(raw).reshape(-1, width))
        return packed([int(frame["id"].iloc[0]) // FAN], r)

    factors = written(vectors.select("embedding", F.spark_partition_id().cast("long").alias("id")).mapInArrow(leaf, schema), "whiten-factors")
    most = factors.agg(F.max("id")).collect()[0][0]
    while most > 0:
        factors, most = factors.groupBy(F.expr(f"id div {FAN}")).applyInPandas(merge, schema), most // FAN
    row = factors.collect()[0]
    return np.frombuffer(row.r).reshape(-1, row.width)


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Sums, directions and variances of vectors (vec_id, embedding), or None without any; what was written for them is deleted."""
    with temporary_tables(vectors.sparkSession):
        return _fitted(vectors, components)


def _fitted(vectors: DataFrame, components: int) -> Fit | None:
    fit = sums(vectors)
    if fit is None:
        return None
    _, s, right = np.linalg.svd(tree_factor(vectors, fit, project=False))
    s = np.pad(s, (0, len(right) - len(s)))
    k = min(components, len(fit.sums))
    fit.known = s[:k] > s[0] * np.finfo(float).eps * max(fit.n, len(s)) ** 0.5 * len(s) if s[0] > 0 else np.zeros(k, bool)
    fit.directions = np.where(fit.known, right[:k].T / np.where(fit.known, s[:k], 1) * fit.n**0.5, 0.0)
    fit.explained = s[:k] ** 2 / max((s**2).sum(), np.finfo(float).tiny)
    r = tree_factor(vectors, fit, project=True)
    off = np.abs(r.T @ r / fit.n - np.eye(k))[np.ix_(fit.known, fit.known)]
    fit.identity_error = float(off.max(initial=0.0))
    return fit


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector of embeddings (vec_id, embedding) and component: its whitened value, with figures of the fit."""
    bounded_batches(embeddings.sparkSession)
    vectors = embeddings.select("vec_id", "embedding")
    kind = vectors.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", kind), *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    fit = fitted(vectors, components)
    if fit is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    d, k = len(fit.sums), len(fit.known)
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                rows, _, x = whole(batch.column(1).slice(lo, ROWS), d)
                z = (fit.centred(x) @ fit.directions).ravel()
                each = np.repeat(np.arange(len(rows)), k)
                of = lambda per_component: np.tile(per_component, len(rows))
                columns = [
                    batch.column(0).slice(lo, ROWS).take(pa.array(rows)).take(pa.array(each)),
                    of(np.arange(1, k + 1, dtype=np.int32)),
                    np.full(len(z), fit.n),
                    pa.array(fit.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(z, pa.float64(), mask=of(~fit.known)),
                    of(fit.explained),
                    np.full(len(z), fit.identity_error),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return vectors.mapInArrow(run, schema)

"""Embedding whitening: streamed covariance, merged across partitions, and a symmetric QR eigen-solve.

Entries become whole numbers, floor(256 * entry). The fit list is each distinct
vector once. Every partition streams its part of the fit list through Welford's
rank-one update of count, mean and scatter (centred products); the states of
partitions are merged by the parallel update formula, in trees of ``FAN`` so that no
task and not the driver holds more than ``FAN`` states. The covariance is brought to
tridiagonal form by Householder reflections and solved by the symmetric QR iteration
with Wilkinson shifts. The same stream then measures the covariance of the whitened
fit list, whose largest departure from the identity is returned beside the rows.

A state is one row of d * d doubles. Nothing else is gathered: distinct vectors are
found by a shuffle after each task has dropped its own repeats, so copies of one
vector, however many, meet as one row a task.

Defined results: rows whose vector is null, or holds a null, a NaN or an infinity, are
dropped; repeated rows are kept, and count once in the fit; vectors of different
lengths are different spaces, each whitened by itself; empty vectors have no components
and give no rows; an empty table gives an empty result. A component without variance
(a constant table, fewer vectors than dimensions) has explained 0 and a null whitened
value, and explained is null where nothing varies. A deviation beyond a long is null;
entries beyond a long are its ends. Other columns are carried in ``row``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwarden.llm.text import read
from inkwarden.session import stage

SCALE, COMPONENTS = 256, 4
#: States that one task merges.
FAN = 16
#: Below this part of the largest eigenvalue, an eigenvalue is rounding and its component has no variance.
NOISE = 1e-13


def quantised(vector: Column) -> Column:
    """The whole-number form of a vector of finite entries, else null."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(vector, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(entries, lambda c: (F.floor(c * SCALE) + 0).cast("long")))


# ---------------------------------------------------------------- streamed moments


@dataclass
class Moments:
    """Count, mean, scatter and exact sums of a stream of vectors."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @classmethod
    def empty(cls, dim: int) -> Moments:
        return cls(0, np.zeros(dim), np.zeros((dim, dim)), [0] * dim)

    def add(self, vectors: np.ndarray) -> None:
        """Welford's update: one rank-one step a vector."""
        step = np.empty_like(self.scatter)
        for x in vectors.astype(np.float64):
            self.n += 1
            before = x - self.mean
            self.mean += before / self.n
            np.multiply(before[:, None], (x - self.mean)[None, :], out=step)
            self.scatter += step

    def merge(self, other: Moments) -> Moments:
        """The parallel update: the moments of both streams together."""
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), scatter, [a + b for a, b in zip(self.sums, other.sums, strict=True)])

    @property
    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * self.n)


STATE = pa.schema([("space", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.binary()), ("scatter", pa.binary())])
STATE_DDL = "space int, at long, n long, sums array<string>, mean binary, scatter binary"


def _row(space: int, at: int, m: Moments) -> dict:
    return {"space": space, "at": at, "n": m.n, "sums": list(map(str, m.sums)), "mean": m.mean.tobytes(), "scatter": m.scatter.tobytes()}


def _moments(row) -> Moments:
    mean = np.frombuffer(row["mean"])
    return Moments(row["n"], mean.copy(), np.frombuffer(row["scatter"]).reshape(mean.size, mean.size).copy(), [int(s) for s in row["sums"]])


def by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, places and the matrix of the vectors of each length in a list column; empty vectors are left out."""
    lengths = np.asarray(column.value_lengths())
    values, ends = np.asarray(column.flatten()), np.cumsum(lengths)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        places = np.flatnonzero(lengths == dim)
        yield dim, places, values[(ends[places] - dim)[:, None] + np.arange(dim)]


def exact_sums(matrix: np.ndarray) -> list[int]:
    most = max(abs(int(matrix.max())), abs(int(matrix.min())))
    wide = matrix if most * len(matrix) < 1 << 62 else matrix.astype(object)
    return [int(s) for s in wide.sum(axis=0)]


def streamed(column: str, models: dict[int, Model] | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's moments, of its vectors or of what ``models`` make of them: one state a space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Moments] = {}
        for batch in batches:
            for space, _, matrix in by_dimension(batch.column(column)):
                if models is None:
                    found = states.setdefault(space, Moments.empty(space))
                    found.sums = [a + b for a, b in zip(found.sums, exact_sums(matrix), strict=True)]
                else:
                    matrix = models[space].whiten(matrix)
                    found = states.setdefault(space, Moments.empty(matrix.shape[1]))
                found.add(matrix)
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([_row(space, at, m) for space, m in sorted(states.items())], schema=STATE)

    return run


def _merge(states: pd.DataFrame) -> pd.DataFrame:
    """The states of one group, all of one space, as one, merged in the order of their partitions."""
    rows = states.sort_values("at").to_dict("records")
    return pd.DataFrame([_row(rows[0]["space"], rows[0]["at"] // FAN, reduce(Moments.merge, map(_moments, rows)))])


def merged(fit: DataFrame, models: dict[int, Model] | None = None) -> dict[int, Moments]:
    """The moments of each space of the fit list; the driver merges the last ``FAN`` states of a space."""
    states = stage(fit.mapInArrow(streamed("x", models), STATE_DDL), "whitening-states")
    while (states.agg(F.max("at")).first()[0] or 0) >= FAN:
        states = stage(states.withColumn("group", F.expr(f"at div {FAN}")).groupBy("space", "group").applyInPandas(lambda g: _merge(g.drop(columns="group")), STATE_DDL), "whitening-states")
    found: dict[int, Moments] = {}
    for row in states.orderBy("space", "at").toLocalIterator():
        m = _moments(row)
        found[row["space"]] = found[row["space"]].merge(m) if row["space"] in found else m
    return found


# ---------------------------------------------------------------- symmetric eigen-problem


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and rows q with matrix = q.T @ T @ q, by Householder reflections."""
    a, size = matrix.astype(np.float64), len(matrix)
    q = np.eye(size)
    for k in range(size - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = -np.copysign(length, a[k + 1, k])
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows: implicit QR steps with Wilkinson's shift, split where a coupling vanishes."""
    d, e, q = tridiagonal(matrix)
    eps, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if small[hi - 1]:
            hi -= 1
            continue
        cuts = np.flatnonzero(small)
        lo = int(cuts[-1]) + 1 if len(cuts) else 0
        half = (d[hi - 1] - d[hi]) / 2
        x, z = d[lo] - (d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))), e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * one + 2 * c * s * off + s * s * two, s * s * one - 2 * c * s * off + c * c * two
            e[k] = c * s * (two - one) + (c * c - s * s) * off
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order]


# ---------------------------------------------------------------- whitening


@dataclass(frozen=True)
class Model:
    """Count, exact sums, the first components as rows, their eigenvalues and the trace of one space."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @classmethod
    def fitted(cls, m: Moments, components: int) -> Model:
        values, vectors = symmetric_qr(m.covariance)
        real = values > NOISE * max(values[0], 0.0)
        return cls(m.n, tuple(m.sums), vectors[:components], np.where(real, values, 0.0)[:components], float(np.trace(m.covariance)))

    @property
    def varied(self) -> np.ndarray:
        return self.values > 0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of the components that vary."""
        centred = x - np.array([s / self.n for s in self.sums])
        return centred @ self.components[self.varied].T / np.sqrt(self.values[self.varied])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - sum) ** 2, exact; None beyond a long."""
        most = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums))
        kind = np.int64 if most * most * x.shape[1] < 1 << 63 else object
        apart = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[dict[int, Model], float]:
    """The models of the spaces of ``vectors`` (x), each distinct one counted once, and the error of the identity."""
    distinct = stage(vectors.where(F.size("x") > 0).select("x").distinct(), "whitening-fit")
    models = {space: Model.fitted(m, components) for space, m in merged(distinct).items()}
    white = merged(distinct, models) if any(m.varied.any() for m in models.values()) else {}
    return models, max((float(np.abs(m.covariance - np.eye(m.mean.size)).max()) for m in white.values() if m.mean.size), default=0.0)


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _applied(models: dict[int, Model], error: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, places, x in by_dimension(batch.column("x")):
                m = models[space]
                k, rows = len(m.values), len(places)
                white = np.full((rows, k), np.nan)
                white[:, m.varied] = m.whiten(x)
                share = m.values / m.trace if m.trace > 0 else np.full(k, np.nan)
                deviations = pa.array(m.deviations(x), pa.int64())
                each = np.repeat(np.arange(rows), k)
                double = lambda v: pa.array(v, pa.float64(), mask=np.isnan(v))
                columns = [
                    batch.column("row").take(pa.array(places[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m.n)),
                    deviations.take(pa.array(each)), double(white.ravel()), double(np.tile(share, rows)), pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", *(c.split()[0] for c in OUT.split(", "))])

    return run


def whitened(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS, carry: list[str] | None = None) -> DataFrame:
    """``row`` (the columns of ``table``, or those to ``carry``) with each component's whitened value and shares, one row a component."""
    rows = table.select(F.struct(*(carry or table.columns)).alias("row"), quantised(F.col(vector)).alias("x")).where("x IS NOT NULL")
    models, error = fit(rows, components)
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(OUT).fields])
    return rows.mapInArrow(_applied(models, error), schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"), carry=["vec_id"]).select("row.vec_id", *(c.split()[0] for c in OUT.split(", ")))

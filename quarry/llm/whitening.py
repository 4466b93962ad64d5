"""Whitening of embeddings by polarisation (operator 11).

Entries are read as doubles and made integers (floor(64 * c) + 1000000), so every sum is exact and the
same in any order of tasks. Two passes fit: the first sums every dimension; the second centres each
value at the floor of its dimension's mean and sums the squares of every dimension and of the sum of
every pair of dimensions. No product of two dimensions is ever taken: as

    var(i + j) = var(i) + var(j) + 2 cov(i, j),

differences of the variances give all covariances. What is left of the mean below its floor (r = S - n c) is
taken out exactly in whole numbers: sum (n x - S)^2 = n^2 sum (x - c)^2 - n r^2. A task sums all its rows
before it sends anything, so the shuffle moves d (d + 1) / 2 numbers for each task, whatever the rows; the
driver holds that many (d dimensions, so at most some thousand) and calls eigh once. A third pass measures
the covariance of the whitened rows against the identity; the fourth writes them.

Defined results: rows whose vector is null or holds a null, infinite or NaN entry are dropped; vectors
of the most frequent length (of equally frequent ones the longest; at least 1) are fitted and returned, others
have no common dimensions with them and are dropped too; entries beyond 2^48 after scaling count as 2^48;
repeated rows and ids, and null ids, count and return each; components whose variance is not above
rounding (rank below the dimensions, all vectors equal, one row) are left out; `deviation` is null where it
exceeds a long; no rows left give no rows; other columns aren't read. Signs: the largest entry of a
component is positive.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import encoding as E
from quarry.llm import exchange as X

SCALE, SHIFT = 64, 1_000_000
MOST = 2**48            # of a scaled entry
COMPONENTS = 32
CELLS = 1 << 20         # numbers of a block of rows
LONG = 2**63 - 1
_SUM = pa.decimal128(38, 0)


@dataclass
class Whitening:
    """n rows, sums of each dimension, components (one a column) by falling variance, their variances and
    shares of all variance, and the largest error of the whitened covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variance: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def floors(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    def deviation(self, u: np.ndarray) -> list[int | None] | np.ndarray:
        """Sum over dimensions of (n x - S)^2, where u = x - floor(S / n)."""
        rest = np.array([s % self.n for s in self.sums], object)
        most = self.n * (int(np.abs(u).max(initial=0)) + 1)
        if most**2 * u.shape[1] <= LONG:
            return ((self.n * u - rest.astype(np.int64)) ** 2).sum(1)
        exact = ((self.n * u.astype(object) - rest) ** 2).sum(1)
        return [int(x) if x <= LONG else None for x in exact]

    def whitened(self, u: np.ndarray) -> np.ndarray:
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (u - rest) @ self.vectors / np.sqrt(self.variance)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries, the offsets of the rows' vectors (n + 1) and which rows remain."""
    column = column.cast(pa.large_list(pa.float64()))
    off = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)      # null entries become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = np.asarray(pc.is_valid(column)) & (bad[off[1:]] == bad[off[:-1]])
    return values, off, good


def _whole(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values), -MOST, MOST).astype(np.int64) + SHIFT


def _blocks(batch: pa.RecordBatch, vector_col: str, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number vectors of the remaining rows of `d` dimensions."""
    values, off, good = _vectors(batch.column(vector_col))
    rows = np.flatnonzero(good & (np.diff(off) == d))
    for lo in range(0, len(rows), max(1, CELLS // d)):
        part = rows[lo:lo + max(1, CELLS // d)]
        yield part, _whole(values[E.ranges(off[part], np.full(len(part), d))]).reshape(-1, d)


def _exact(x: np.ndarray) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in x], _SUM)


def _summed(vector_col: str):
    """Task: for each length of vectors, rows and sums of the dimensions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = {}, {}
        for batch in batches:
            values, off, good = _vectors(batch.column(vector_col))
            for d in np.unique(np.diff(off)[good]):
                if d:
                    for _, x in _blocks(batch, vector_col, int(d)):
                        n[int(d)] = n.get(int(d), 0) + len(x)
                        sums[int(d)] = sums.get(int(d), 0) + x.sum(0).astype(object)
        if n:
            yield pa.record_batch({"d": pa.array(list(n), pa.int32()), "n": pa.array(list(n.values()), pa.int64()),
                                   "sums": pa.array([[Decimal(int(v)) for v in sums[d]] for d in n], pa.list_(_SUM))})
    return run


def _squared(vector_col: str, floors: np.ndarray):
    """Task: sums of squares of each centred dimension i (first of its list) and of its sum with each
    later dimension."""
    d = len(floors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(d - i, object) for i in range(d)]
        seen = False
        for batch in batches:
            for _, x in _blocks(batch, vector_col, d):
                u = np.ascontiguousarray((x - floors).T)
                fits = (2 * int(np.abs(u).max(initial=0)))**2 * u.shape[1] <= LONG
                u, seen = u if fits else u.astype(object), True
                for i in range(d):
                    both = u[i:] + u[i]
                    both[0] = u[i]
                    total[i] += (np.einsum("jr,jr->j", both, both) if fits else (both * both).sum(1)).astype(object)
        if seen:
            yield pa.record_batch({"i": pa.array(range(d), pa.int32()), "squares": pa.array([[Decimal(int(v)) for v in t] for t in total], pa.list_(_SUM))})
    return run


def _checked(vector_col: str, model: Whitening):
    """Task: sums of the whitened rows and of their products."""
    d, k = model.vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in _blocks(batch, vector_col, d):
                w = model.whitened(x - model.floors)
                total += np.vstack([w.sum(0), w.T @ w])
        yield pa.record_batch({"i": pa.array(range(k + 1), pa.int32()), "sums": pa.array(total.tolist(), pa.list_(pa.float64()))})
    return run


def _totals(parts: DataFrame, lists: str) -> dict[tuple[int, int], object]:
    """Sums of equal places of the lists of each i: one number for each dimension and pair of them."""
    one = parts.select("i", F.posexplode(lists).alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): r["v"] for r in one.collect()}


def covariance(n: int, sums: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix, divisor n, from exact sums of squares by polarisation."""
    d = len(sums)
    rest = [s % n for s in sums]
    spread = [n * n * squares[i, 0] - n * rest[i]**2 for i in range(d)]      # sums of (n x - S)^2
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = spread[i] / n**3
        for j in range(i + 1, d):
            both = n * n * squares[i, j - i] - n * (rest[i] + rest[j])**2
            out[i, j] = out[j, i] = (both - spread[i] - spread[j]) / (2 * n**3)
    return out


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors; None if there are none or they don't vary."""
    rows = rows.select(vector_col)
    parts = X.table(rows.mapInArrow(_summed(vector_col), "d int, n long, sums array<decimal(38,0)>"), "whitening-sums")
    found = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if found is None:
        return None
    n, d = found["n"], found["d"]
    sums = _totals(parts.filter(F.col("d") == d).select(F.lit(0).alias("i"), "sums"), "sums")
    sums = [int(sums[0, j]) for j in range(d)]
    floors = np.array([s // n for s in sums], np.int64)
    parts = rows.mapInArrow(_squared(vector_col, floors), "i int, squares array<decimal(38,0)>")
    matrix = covariance(n, sums, {k: int(v) for k, v in _totals(parts, "squares").items()})
    e, v = np.linalg.eigh(matrix)
    e, v = e[::-1], v[:, ::-1]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    k = min(components, int((e > d * np.finfo(float).eps * max(e[0], 0)).sum()))
    if not k:
        return None
    model = Whitening(n, sums, np.ascontiguousarray(v[:, :k]), e[:k].copy(), e[:k] / np.trace(matrix))
    got = _totals(rows.mapInArrow(_checked(vector_col, model), "i int, sums array<double>"), "sums")
    mean = np.array([got[0, j] for j in range(k)]) / n
    second = np.array([[got[i + 1, j] for j in range(k)] for i in range(k)]) / n
    model.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return model


def _emptied(id_col: str, names: dict[str, str]):
    return f"{id_col} long, " + ", ".join(f"{n} {t}" for n, t in names.items())


_ROW = {"whitened": "array<double>", "deviation": "long"}
_DIGEST = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}


def transform(rows: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable vector of the model's dimensions: its id, `whitened` (all components) and
    `deviation`."""
    schema = _emptied(id_col, _ROW)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _blocks(batch, vector_col, len(model.sums)):
                u = x - model.floors
                w = model.whitened(u)
                yield pa.record_batch({
                    id_col: batch.column(id_col).take(pa.array(at)),
                    "whitened": pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.reshape(-1))),
                    "deviation": pa.array(model.deviation(u), pa.int64())})
    return rows.select(F.col(id_col).cast("long").alias(id_col), vector_col).mapInArrow(run, schema)


def digest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Every usable vector and component: n, deviation, whitened, explained and identity_error."""
    model = fit(rows, vector_col, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], _emptied(id_col, _DIGEST))
    share = F.array(*[F.lit(float(x)) for x in model.explained])
    one = transform(rows, model, id_col, vector_col).select(id_col, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return one.select(id_col, (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(share, F.col("place") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))

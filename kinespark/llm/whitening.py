"""Whitening of integer vectors by covariances from variances alone.

The variance of a sum is that of its parts and twice their covariance, so all covariances follow
from the squared deviations of every dimension and of every sum of two: cov(i, j) is half of
var(i + j) - var(i) - var(j). Tasks add those squares up exactly, in integers; what reaches the
driver is one total for each dimension and pair, which eigh takes apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows whose sums of squares are formed at once.
BLOCK = 1024
#: Totals travel as high * LIMB + low, so that no size of table or entry overflows a decimal.
LIMB = 1 << 60
#: Eigenvalues up to this share of the largest are rounding, not directions.
FLAT = 1e-12
_TOTALS = "at int, high decimal(38,0), low decimal(38,0)"


def _integers(column: pa.Array, scale: int, shift: int, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): which vectors take part, and their entries floor(scale * c) + shift as longs.
    Out are null vectors, those with null or non-finite entries or integers of 2^61 or more in
    size, empty ones, and those that aren't of this length."""
    n = len(column)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    if size is None:
        size = int(lengths.max(initial=0))
    rows = np.flatnonzero((lengths == size) & (size > 0) & np.asarray(column.is_valid()))
    if not len(rows):
        return rows, np.empty((0, size), np.int64)
    picked = column if len(rows) == n else column.take(pa.array(rows))
    flat = picked.flatten()
    c = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    if flat.null_count:
        c = np.where(np.asarray(flat.is_null()).reshape(c.shape), np.nan, c)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(scale * c)
    good = (np.abs(scaled) < 2.0**61).all(axis=1)
    return rows[good], scaled[good].astype(np.int64) + shift


def _totals(found: dict[int, int]) -> pa.RecordBatch:
    parts = [divmod(v, LIMB) for v in found.values()]
    kind = pa.decimal128(38, 0)
    high, low = (pa.array([Decimal(p[i]) for p in parts], kind) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), high, low], ["at", "high", "low"])


def _collected(totals: DataFrame) -> dict[int, int]:
    """Totals by place; as many rows as there are dimensions and pairs."""
    summed = totals.groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {r["at"]: int(r["high"]) * LIMB + int(r["low"]) for r in summed.collect()}


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """x in a type that holds sums up to the bound."""
    return x if bound < 1 << 62 else x.astype(object)


class Whitening:
    """A fit: n, the sums, the covariance (divisor n), and unit components by falling eigenvalue,
    the largest entry of each positive."""

    def __init__(self, n: int, sums: list[int], squares: dict[int, int]):
        """squares: sum of squared deviations times n^2 for each place, see places()."""
        d = self.size = len(sums)
        self.n, self.sums = n, sums
        v = np.zeros((d, d))
        for i in range(d):
            v[i, i] = squares[i] / n**3
        for at, (i, j) in enumerate(self.places(d), d):
            v[i, j] = v[j, i] = (squares[at] - squares[i] - squares[j]) / (2 * n**3)
        self.covariance = v
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        some = int((values > FLAT * max(values[0], 0.0)).sum()) if d and values[0] > 0 else 0
        self.values, vectors = values[:some], vectors[:, :some]
        top = np.abs(vectors).argmax(axis=0)
        self.vectors = vectors * np.sign(vectors[top, np.arange(some)])
        self.explained = self.values / np.trace(v) if some else self.values

    @staticmethod
    def places(d: int) -> list[tuple[int, int]]:
        """Pairs of dimensions by their distance, in the order of the totals after those of the
        single dimensions."""
        return [(i, i + k) for k in range(1, d) for i in range(d - k)]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The integer next to each mean, and what n times it leaves of the sum."""
        near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(near, np.int64), np.array([s - self.n * m for s, m in zip(self.sums, near, strict=True)], object)

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        near, rest = self.centre()
        centred = (x - near).astype(np.float64) - np.array([r / self.n for r in rest])
        return centred @ self.vectors[:, :k] / np.sqrt(self.values[:k])


def fit(vectors: DataFrame, column: str = "embedding", scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """The fit of all usable vectors of `column` (array of a number type); None without any.

    Two passes. The first counts vectors by length and adds up their entries; the commonest
    length is the table's (the longer of equals). The second centres every entry by the integer
    next to its mean, squares it and each sum of two, and adds up; what the integer leaves of
    the mean is taken off the totals exactly. Tables of one value or one row have no components.
    """
    source = vectors.select(F.col(column).alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[int, list] = {}
        for batch in batches:
            v = batch.column("v")
            for size in np.unique(np.asarray(v.value_lengths().fill_null(0))):
                _, x = _integers(v, scale, shift, int(size))
                if len(x):
                    found = counted.setdefault(int(size), [0, np.zeros(int(size), object)])
                    found[0] += len(x)
                    found[1] = found[1] + _exact(x, int(np.abs(x).max()) * len(x)).sum(axis=0)
        for size, (n, total) in counted.items():
            batch = _totals({-1: n} | dict(enumerate(map(int, total))))
            yield pa.RecordBatch.from_arrays([pa.array([size] * batch.num_rows, pa.int32()), *batch.columns], ["size", *batch.schema.names])

    by_size = cut(source.mapInArrow(sums, f"size int, {_TOTALS}").groupBy("size", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")))
    # the commonest length is picked before anything is collected
    counts = by_size.where("at = -1").orderBy(F.desc("high"), F.desc("low"), F.desc("size")).limit(1).collect()
    if not counts:
        return None
    d, n = counts[0]["size"], int(counts[0]["high"]) * LIMB + int(counts[0]["low"])
    total = _collected(by_size.where((F.col("size") == d) & (F.col("at") >= 0)).select("at", "high", "low"))
    sums_of = [total[i] for i in range(d)]
    near = np.array([(2 * s + n) // (2 * n) for s in sums_of], np.int64)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(d + d * (d - 1) // 2, object)
        some = False
        for batch in batches:
            _, x = _integers(batch.column("v"), scale, shift, d)
            for lo in range(0, len(x), BLOCK):
                y = _exact(x[lo : lo + BLOCK], 0)
                some, low, high = True, int(y.min()), int(y.max())
                widest = max(abs(low - int(near.max())), abs(high - int(near.min())))
                y = _exact(y, widest * 2) - near
                y = _exact(y, 4 * widest * widest * BLOCK)
                parts = [(y * y).sum(axis=0)]
                for k in range(1, d):
                    pair = y[:, :-k] + y[:, k:]
                    parts.append((pair * pair).sum(axis=0) if pair.dtype == object else np.einsum("ij,ij->j", pair, pair))
                found = found + np.concatenate(parts)
        if some:
            yield _totals(dict(enumerate(map(int, found))))

    total = _collected(source.mapInArrow(squares, _TOTALS))
    rest = [s - n * int(m) for s, m in zip(sums_of, near, strict=True)]
    # sum (n x - S)^2 is n^2 times the sum of squares about the integer, less n times the square of what it leaves
    left = rest + [rest[i] + rest[j] for i, j in Whitening.places(d)]
    return Whitening(n, sums_of, {at: n * n * total[at] - n * r * r for at, r in enumerate(left)})


def whiten(vectors: DataFrame, components: int = 8, column: str = "embedding", key: str = "vec_id", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), one for each
    usable vector and each of the first `components` components.

    An entry c becomes x = floor(scale * c) + shift. Null vectors, empty ones, those with null or
    non-finite entries (or integers of 2^61 or more in size), and those of another length than the table's
    commonest take no part. deviation is the sum over dimensions of (n x - S)^2, exact, and null
    beyond a long; whitened is x - S / n on the component over the root of its eigenvalue;
    explained the eigenvalue's share of the trace; identity_error the largest absolute entry of
    the whitened columns' covariance less the identity, measured over all rows. Components with
    no variance are left out, so equal vectors, one vector or an empty table give no rows. Null
    keys, repeated rows and ties keep their rows; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    found = fit(vectors, column, scale, shift)
    k = min(components, len(found.values)) if found else 0
    kind = vectors.schema[key].dataType
    source = vectors.select(F.col(key).alias("key"), F.col(column).alias("v"))
    columns = "n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], f"{key} {kind.simpleString()}, component int, {columns}")
    d, n = found.size, found.n
    near, rest = found.centre()
    left = rest.astype(np.int64)  # less than n each

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = found.project(_integers(batch.column("v"), scale, shift, d)[1], k)
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["at", "s"])

    sums = {r["at"]: r["s"] for r in source.select("v").mapInArrow(moments, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    total = np.array([sums[i] for i in range(k + k * k)]) / n
    error = float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _integers(batch.column("v"), scale, shift, d)
            y = x - near
            far = int(np.abs(y).max(initial=0))
            square = (_exact(y, far * far * d) ** 2).sum(axis=1).astype(object)
            crossed = (_exact(y, far * n * d) * (left if far * n * d < 1 << 62 else rest)).sum(axis=1).astype(object)
            exact = n * n * square - 2 * n * crossed + sum(r * r for r in rest)
            deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            every = np.repeat(np.arange(len(at)), k)
            m = len(every)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(at[every])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(m, n)),
                    deviation.take(pa.array(every)),
                    pa.array(found.project(x, k).ravel()),
                    pa.array(np.tile(found.explained[:k], len(at))),
                    pa.array(np.full(m, error)),
                ],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return source.mapInArrow(rows, f"key {kind.simpleString()}, component int, {columns}").withColumnRenamed("key", key)

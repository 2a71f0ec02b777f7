"""Boxes moved by the motion of points: a robust partial affine fit (scale, turn, shift) of point
pairs by consensus, and the median shift where it fails. Points are numbers of the rows; where
they come from, images or other sensors, is nothing to this part."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs for a fit, distance of a pair that agrees with it, samples, and the scales
#: beyond which the median shift counts.
LEAST, AGREES, SAMPLES, SCALES = 4, 2.0, 100, (0.75, 1.35)
#: Samples are drawn by one seed, so that equal rows give equal results; and offsets that differ by
#: rounding count as equal, so that these don't hang on the rows beside them.
SEED, DIGITS = 20_240_229, 6


#: Numbers of the offsets of samples by pairs that are held at once.
HELD = 1 << 16


@lru_cache(256)
def _samples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """SAMPLES draws of two of n pairs. A draw that comes again, either way round, gives the same
    fit, so the first of them stands for all."""
    draw = np.random.default_rng(SEED)
    i = draw.integers(0, n, SAMPLES)
    j = (i + draw.integers(1, n, SAMPLES)) % n
    first = np.sort(np.unique(np.minimum(i, j) * n + np.maximum(i, j), return_index=True)[1])
    return i[first], j[first]


def _offsets(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """|a p + b - q| of numbers given as real and imaginary parts in the first axis."""
    x = a[0] * p[0]
    x -= a[1] * p[1]
    x += b[0]
    x -= q[0]
    y = a[1] * p[0]
    y += a[0] * p[1]
    y += b[1]
    y -= q[1]
    x *= x
    y *= y
    x += y
    return np.sqrt(x, out=x)


def _consensus(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs (2, n, rows) agree with the best sample of their row, (n, rows); none where no
    sample has two points. All samples of many rows are tried at once."""
    i, j = _samples(p.shape[1])
    way, to = p[:, j] - p[:, i], q[:, j] - q[:, i]
    size = way[0] * way[0] + way[1] * way[1]
    some = np.sqrt(size) > 1e-9
    size[~some] = 1.0
    a = np.stack([to[0] * way[0] + to[1] * way[1], to[1] * way[0] - to[0] * way[1]]) / size
    b = q[:, i] - np.stack([a[0] * p[0][i] - a[1] * p[1][i], a[1] * p[0][i] + a[0] * p[1][i]])
    off = _offsets(a[:, :, None], b[:, :, None], p[:, None], q[:, None])  # samples, n, rows
    near = off <= AGREES + 10**-DIGITS
    count = np.where(some, near.sum(axis=1), -1)
    off[~near] = 0.0
    apart = np.where(count == count.max(axis=0), off.sum(axis=1).round(DIGITS), np.inf)
    best = apart.argmin(axis=0)  # the first of equals
    rows = np.arange(p.shape[2])
    return near[best, :, rows].T & some[best, rows]


def partial_affines(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrices (rows, 2, 3), which pairs agree (rows, n)) of the scale, turn and shift that most
    pairs (rows, n, 2) of each row agree with, fitted to them by least squares; NaN with fewer
    than LEAST pairs or two that agree.

    A point is a complex number, so a move is a z + b and two pairs fix it. Of samples with as many
    agreeing pairs the one that leaves them least apart counts. Rows lie in the last axis of the
    arrays, as there are more of them than pairs.
    """
    rows, n = before.shape[:2]
    matrix, agrees = np.full((rows, 2, 3), np.nan), np.zeros((rows, n), bool)
    if n < LEAST:
        return matrix, agrees
    most = max(1, HELD // (len(_samples(n)[0]) * n))
    with np.errstate(all="ignore"):
        for at in range(0, rows, most):
            p, q = (np.ascontiguousarray(v[at : at + most].transpose(2, 1, 0)) for v in (before, after))
            agree = _consensus(p, q)
            k = np.arange(p.shape[2])  # rows still fitted to those that agree, until they stay the same
            for _ in range(10):
                k = k[agree[:, k].sum(axis=0) >= 2]
                if not len(k):
                    break
                own, u, v = agree[:, k], p[:, :, k], q[:, :, k]
                count = own.sum(axis=0)
                middle, goal = (np.where(own, w, 0.0).sum(axis=1) / count for w in (u, v))
                x, y = (np.where(own, w - m[:, None], 0.0) for w, m in ((u, middle), (v, goal)))
                spread = (x * x).sum(axis=(0, 1))
                a = np.stack([(x * y).sum(axis=(0, 1)), (x[0] * y[1] - x[1] * y[0]).sum(axis=0)]) / spread
                b = goal - np.stack([a[0] * middle[0] - a[1] * middle[1], a[1] * middle[0] + a[0] * middle[1]])
                now = _offsets(a[:, None], b[:, None], u, v) <= AGREES + 10**-DIGITS
                fits = spread > 1e-12
                matrix[at + k] = np.where(fits, [[a[0], -a[1], b[0]], [a[1], a[0], b[1]]], np.nan).transpose(2, 0, 1)
                on = fits & (now != own).any(axis=0) & (now.sum(axis=0) >= count)
                agree[:, k[on]] = now[:, on]
                k = k[on]
            matrix[at : at + most][agree.sum(axis=0) < 2] = np.nan
            agrees[at : at + most] = agree.T
    return matrix, agrees


def partial_affine(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """partial_affines() of one row of pairs (n, 2), or None."""
    matrix, agrees = partial_affines(before[None], after[None])
    return None if np.isnan(matrix[0, 0, 0]) else (matrix[0], agrees[0])


def clipped(boxes: np.ndarray, width: int, height: int) -> np.ndarray:
    """The boxes (rows, 4) within the pixels, each side 2 at least; NaN where one is under 4."""
    x1, y1 = np.minimum(np.maximum(boxes[:, 0], 0.0), width - 2.0), np.minimum(np.maximum(boxes[:, 1], 0.0), height - 2.0)
    x2, y2 = np.minimum(np.maximum(boxes[:, 2], x1 + 2), width - 1.0), np.minimum(np.maximum(boxes[:, 3], y1 + 2), height - 1.0)
    out = np.stack([x1, y1, x2, y2], axis=1)
    least = 4 - 10**-DIGITS
    out[~((x2 - x1 >= least) & (y2 - y1 >= least))] = np.nan
    return out


HOW = np.array(["affine", "median", "lost"], object)


def moved_many(boxes: np.ndarray, pairs: np.ndarray, counts: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """(boxes around the moved corners, NaN where lost; how, numbers of HOW) of boxes (rows, 4) and
    their pairs, which stand one row's after another's in `pairs`, `counts` of each. The median
    shift counts without a fit and where its scale is beyond SCALES; without pairs the box is
    lost. Rows with as many pairs are moved together."""
    out, how = np.full((len(boxes), 4), np.nan), np.full(len(boxes), 2)
    starts = np.cumsum(counts) - counts
    for n in np.unique(counts[counts > 0]):
        at = np.flatnonzero(counts == n)
        own = pairs[starts[at][:, None] + np.arange(n)]
        matrix, _ = partial_affines(own[:, :, :2], own[:, :, 2:])
        with np.errstate(all="ignore"):
            scale = np.hypot(matrix[:, 0, 0], matrix[:, 1, 0])
            median = ~((scale >= SCALES[0]) & (scale <= SCALES[1]))
            if median.any():
                matrix[median, :, :2] = np.eye(2)
                matrix[median, :, 2] = np.median(own[median, :, 2:] - own[median, :, :2], axis=1)
            x, y = boxes[at][:, [0, 2, 0, 2]], boxes[at][:, [1, 1, 3, 3]]
            u, v = (matrix[:, i, :1] * x + matrix[:, i, 1:2] * y + matrix[:, i, 2:] for i in (0, 1))
            out[at] = clipped(np.stack([u.min(axis=1), v.min(axis=1), u.max(axis=1), v.max(axis=1)], axis=1), width, height)
        how[at] = np.where(np.isnan(out[at, 0]), 2, median)
    return out, how


def moved(box: np.ndarray, before: np.ndarray, after: np.ndarray, width: int, height: int) -> tuple[np.ndarray | None, str]:
    """moved_many() of one box: (the moved one or None, how: affine, median or lost)."""
    out, how = moved_many(box[None], np.c_[before, after], np.array([len(before)]), width, height)
    return None if how[0] == 2 else out[0], HOW[how[0]]


def inside(box: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The pairs (n, 4) whose first point lies in the box."""
    return pairs[(pairs[:, 0] >= box[0]) & (pairs[:, 0] <= box[2]) & (pairs[:, 1] >= box[1]) & (pairs[:, 1] <= box[3])]


def pairs_of(rows) -> np.ndarray:
    """Pairs of a row (arrays x, y, u, v: a point and where it went) as (n, 4); those with a null
    or non-finite number don't count."""
    if rows is None or not len(rows):
        return np.empty((0, 4))
    found = np.array([[np.nan if v is None else v for v in r] if r is not None else [np.nan] * 4 for r in rows], float)
    return found[np.isfinite(found).all(axis=1)]


def numbers_of(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows (n, size), which are whole) of an Arrow array of lists of numbers; a list that is null,
    of another size, or has a null or non-finite number isn't whole."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    out = np.full((len(sizes), size), np.nan)
    right = sizes == size
    if right.all():
        out = flat.reshape(-1, size)
    elif right.any():
        out[right] = flat[(np.cumsum(sizes) - sizes)[right][:, None] + np.arange(size)]
    return out, np.isfinite(out).all(axis=1)


def pairs_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """pairs_of() for an Arrow array of rows: (their pairs one after another, (n, 4); how many each
    row has)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    pairs, whole = numbers_of(column.flatten(), 4)
    if whole.all():
        return pairs, sizes
    return pairs[whole], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[whole], minlength=len(sizes))


def moved_boxes(df: DataFrame, width: int, height: int, keep: list[str] | None = None) -> DataFrame:
    """df (box; pairs: array of [x, y, u, v]) with `moved` (null if lost) and `how`; see
    moved_many(). A null box is lost. Rows stay where they are, with the columns `keep` (all if
    None); columns of these names are replaced."""
    rest = [c for c in (df.columns if keep is None else keep) if c not in ("moved", "how")]
    kept = df.select(*rest, *[F.col(c).alias(f"__{c}") for c in ("box", "pairs") if c not in rest])
    place = [kept.columns.index(c if c in rest else f"__{c}") for c in ("box", "pairs")]
    schema = T.StructType([*kept.schema.fields[: len(rest)], T.StructField("moved", T.ArrayType(T.DoubleType())), T.StructField("how", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes, whole = numbers_of(batch.column(place[0]), 4)
            pairs, counts = pairs_in(batch.column(place[1]))
            if not whole.all():
                pairs, counts = pairs[np.repeat(whole, counts)], np.where(whole, counts, 0)
            out, how = moved_many(boxes, pairs, counts, width, height)
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * 4), pa.array(out.ravel()), mask=pa.array(how == 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], found, pa.array(HOW[how], pa.string())], names=[*rest, "moved", "how"])

    return kept.mapInArrow(run, schema)


def box_points(box) -> list[F.Column]:
    """Nine points of a box (array of four): corners, edges' middles and centre, as arrays."""
    x = [F.get(box, F.lit(0)), (F.get(box, F.lit(0)) + F.get(box, F.lit(2))) / 2, F.get(box, F.lit(2))]
    y = [F.get(box, F.lit(1)), (F.get(box, F.lit(1)) + F.get(box, F.lit(3))) / 2, F.get(box, F.lit(3))]
    return [F.array(a, b) for b in y for a in x]


def points_of_box(box) -> F.Column:
    """box_points() as one array."""
    return F.array(*box_points(box))

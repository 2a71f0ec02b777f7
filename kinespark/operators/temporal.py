"""Order-dependent operators over series: gap fill, smoothing, clocks and as-of joins.

A series is partitioned by its keys (with a sequence id, so that long recordings split); the
clock is an integer column, and a gap is a missing integer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quantiles


def islands(df: DataFrame, keys: list[str], clock: str) -> DataFrame:
    """df with `island`, equal for rows of unbroken clock."""
    return df.withColumn("island", F.col(clock) - F.row_number().over(Window.partitionBy(*keys).orderBy(clock)))


def gaussian(df: DataFrame, keys: list[str], clock: str, values: list[str], radius: int = 2, sigma: float = 1.0) -> DataFrame:
    """Centred weights exp(-(d / sigma)^2 / 2) within `radius`, never across a gap."""
    w = Window.partitionBy(*keys, "island").orderBy(clock)
    rows = islands(df, keys, clock)
    weights = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)}

    def smooth(name: str) -> Column:
        total = mass = F.lit(0.0)
        for d, k in weights.items():
            near = F.lag(name, -d).over(w) if d else F.col(name)
            total, mass = total + F.coalesce(near * k, F.lit(0.0)), mass + F.when(near.isNotNull(), F.lit(k)).otherwise(0.0)
        return total / mass

    return rows.select(*[c for c in df.columns if c not in values], *[smooth(v).alias(v) for v in values])


def ema(df: DataFrame, keys: list[str], clock: str, value: str, alpha: float) -> DataFrame:
    """Causal exponential mean, starting anew after each gap. Streams through each partition in
    clock order, so a long series costs linear time and constant memory."""
    names = [*keys, clock, value]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, y = None, 0.0
        for frame in frames:
            out = np.empty(len(frame))
            for i, row in enumerate(frame.itertuples(index=False)):
                key, t, x = tuple(row[: len(keys)]), row[len(keys)], row[len(keys) + 1]
                y = alpha * x + (1 - alpha) * y if at == (key, t - 1) else x
                at, out[i] = (key, t), y
            yield frame.assign(**{value: out})

    rows = df.select(*names).repartition(*keys).sortWithinPartitions(*keys, clock)
    return rows.mapInPandas(run, rows.schema)


def bidirectional_ema(df: DataFrame, keys: list[str], clock: str, value: str, alpha: float) -> DataFrame:
    """Mean of the exponential means forwards and backwards; gaps don't matter. Both stream
    through the partition, the second in the order of the first turned round, so a long series
    costs linear time and constant memory."""
    size = len(keys)

    def run(back: bool):
        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, y, n = None, None, 0
            for batch in batches:
                out = []
                for key, x in zip(zip(*(batch.column(i).to_pylist() for i in range(size)), strict=True), batch.column(size + 1).to_pylist(), strict=True):
                    if key != at:
                        at, y = key, x
                    else:
                        y = None if x is None or y is None else alpha * x + (1 - alpha) * y
                    out.append(y)
                columns, y_column = batch.columns[: size + 1], pa.array(out, pa.float64())
                if back:
                    columns += [pc.divide(pc.add(batch.column(size + 2), y_column), 2.0)]
                else:
                    columns += [batch.column(size + 1), y_column, pa.array(range(n, n + len(out)), pa.int64())]
                    n += len(out)
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)] if not back else [*names[: size + 1], value])

        return mean

    names = [*keys, clock, value, "__f", "__n"]
    rows = df.select(*keys, clock, F.col(value).cast("double").alias(value))
    schema = T.StructType([*rows.schema.fields, T.StructField("__f", T.DoubleType()), T.StructField("__n", T.LongType())])
    there = rows.repartition(*keys).sortWithinPartitions(*keys, clock, value).mapInArrow(run(False), schema)
    return there.sortWithinPartitions(*keys, F.desc("__n")).mapInArrow(run(True), rows.schema)


def _median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2


def hampel(df: DataFrame, keys: list[str], clock: str, values: list[str], radius: int = 3, threshold: float = 0.0, k: float = 3.0) -> DataFrame:
    """A point (its coordinates in the columns `values`) further from the median point of its
    window than max(threshold, k * 1.4826 * MAD) becomes that point; MAD is the median deviation
    of the window's distances from their median. Windows go by position and are cut at the ends."""
    w = Window.partitionBy(*keys).orderBy(clock).rowsBetween(-radius, radius)
    rows = df.withColumn("__w", F.collect_list(F.array(*values)).over(w))

    def coordinate(i: int) -> Column:
        return F.transform("__w", lambda p: F.get(p, F.lit(i)))

    rows = rows.withColumn("__m", F.array(*[_median(coordinate(i)) for i in range(len(values))]))

    def apart(p: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(p, "__m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))

    rows = rows.withColumn("__d", F.transform("__w", apart)).withColumn("__c", _median(F.col("__d")))
    mad = _median(F.transform("__d", lambda d: F.abs(d - F.col("__c"))))
    far = apart(F.array(*values)) > F.greatest(F.lit(threshold), k * 1.4826 * mad)
    rows = rows.withColumn("replaced", far)
    return rows.withColumns({v: F.when(F.col("replaced"), F.get("__m", F.lit(i))).otherwise(F.col(v)) for i, v in enumerate(values)}).drop("__w", "__m", "__d", "__c")


def smooth_sequence(df: DataFrame, keys: list[str], clock: str, values: list[str], radius: int = 2, threshold: float = 0.055, k: float = 4.0, alpha: float = 0.72, blend: float = 0.55) -> DataFrame:
    """(keys, clock, values, replaced, delta): hampel(), then 1 - blend of it and blend of its
    two-way exponential mean; delta is how far the point moved in all."""
    names = [*keys, clock]
    clean = hampel(df.select(*names, *values), keys, clock, values, radius, threshold, k)
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(v).alias("v")) for i, v in enumerate(values)])).alias("a")
    long = clean.select(*names, axes).select(*names, "a.axis", "a.v")
    mean = bidirectional_ema(long, [*keys, "axis"], clock, "v", alpha)
    wide = mean.groupBy(*names).agg(*[F.max(F.when(F.col("axis") == i, F.col("v"))).alias(f"__{v}") for i, v in enumerate(values)])
    given = df.select(*names, *[F.col(v).alias(f"__was_{v}") for v in values])
    out = clean.join(wide, names).join(given, names).withColumns({v: (1 - blend) * F.col(v) + blend * F.col(f"__{v}") for v in values})
    delta = F.sqrt(sum(((F.col(v) - F.col(f"__was_{v}")) * (F.col(v) - F.col(f"__was_{v}")) for v in values), F.lit(0.0)))
    return out.withColumn("delta", delta).select(*names, *values, "replaced", "delta")


def velocity(df: DataFrame, keys: list[str], clock: str, value: str) -> DataFrame:
    """Half the difference of the neighbours one tick away; a missing one counts as the row."""
    w = Window.partitionBy(*keys).orderBy(clock)

    def near(step: int) -> Column:
        there = F.lag(clock, -step).over(w) == F.col(clock) + step
        return F.when(there, F.lag(value, -step).over(w)).otherwise(F.col(value))

    return df.withColumn("velocity", 0.5 * (near(1) - near(-1)))


def carried_forward(df: DataFrame, keys: list[str], clock: str, value: str) -> DataFrame:
    """The latest value so far that isn't null."""
    w = Window.partitionBy(*keys).orderBy(clock).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def frame_rate(df: DataFrame, keys: list[str], group: str, seconds: str, default: float = 25.0) -> DataFrame:
    """1 / median step in time between frames of consecutive groups, of steps over 0 and under
    1 s; `default` where there is none. A missing group makes no step."""
    w = Window.partitionBy(*keys).orderBy(group, seconds)
    steps = df.select(*keys, (F.col(seconds) - F.lag(seconds).over(w)).alias("step"), (F.col(group) - F.lag(group).over(w)).alias("by"))
    good = steps.where("by = 1 and step > 0 and step < 1")
    rate = quantiles.exact(good, keys, "step", {"step": 0.5}).select(*keys, (1 / F.col("step")).alias("fps"))
    return df.select(*keys).distinct().join(rate, keys, "left").withColumn("fps", F.coalesce("fps", F.lit(default)))


def fill_gaps(h: DataFrame, keys: list[str], clock: str, most: int, displacement: float, bone_change: float, bones: list[tuple[int, int]], others: tuple[str, ...] = (), allowed: DataFrame | None = None) -> DataFrame:
    """(keys, clock, joints, others) of the ticks missing between two rows: linear blends, where
    at most `most` ticks are missing, no point moves more than `displacement`, and no bone's
    length changes by more than the share `bone_change` of the mean of both lengths. `others`
    are more arrays of points, blended alike and null where an end has none. `allowed`, with the
    column `clock`, names the ticks asked for: a gap with another tick stays open."""
    w = Window.partitionBy(*keys).orderBy(clock)
    arrays = ["joints", *others]
    pairs = h.select(*keys, F.col(clock).alias("__t"), F.lead(clock).over(w).alias("__u"), *arrays, *[F.lead(c).over(w).alias(f"__{c}") for c in arrays])
    pairs = pairs.where((F.col("__u") - F.col("__t")).between(2, most + 1))

    def apart(p: Column, q: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))

    moved = F.array_max(F.zip_with("joints", "__joints", apart))

    def bone(j: str, i: int, k: int) -> Column:
        return apart(F.get(j, F.lit(i)), F.get(j, F.lit(k)))

    was, now = (F.array(*[bone(j, i, k) for i, k in bones]) for j in ("joints", "__joints"))
    change = F.array_max(F.zip_with(was, now, lambda a, b: F.abs(b - a) / F.greatest(0.5 * (a + b), F.lit(1e-8))))
    kept = pairs.where((moved <= displacement) & (change <= bone_change))
    ticks = kept.withColumn("__tick", F.explode(F.sequence(F.col("__t") + 1, F.col("__u") - 1)))
    if allowed is not None:
        asked = allowed.select(F.col(clock).alias("__tick")).distinct().withColumn("__asked", F.lit(1))
        whole = Window.partitionBy(*keys, "__t")
        ticks = ticks.join(asked, "__tick", "left").withColumn("__all", F.count("__asked").over(whole) == F.count("*").over(whole)).where("__all").drop("__asked", "__all")
    alpha = (F.col("__tick") - F.col("__t")) / (F.col("__u") - F.col("__t"))

    def blend(c: str) -> Column:
        return F.zip_with(c, f"__{c}", lambda p, q: F.zip_with(p, q, lambda x, y: (1 - alpha) * x + alpha * y)).alias(c)

    return ticks.select(*keys, F.col("__tick").alias(clock), *[blend(c) for c in arrays])


def asof(marks: DataFrame, stream: DataFrame, mark: str, frame: str, hand: str, value: str, nearest: bool, keys: tuple[str, ...] = (), span: int = 4096) -> DataFrame:
    """marks (with a fractional frame in `mark`) times the hands of the stream, within `keys`
    (such as the recording, whose clocks are its own): the value at the mark, blended between the
    frames on either side or, if `nearest`, of the nearer one (the upper on a tie). Null where a
    side is missing or lacks the hand; frames of any hand count as sides. The clock is cut in
    spans: each mark looks in its own span's rows and carries the nearest frames of the other
    spans, so no task sees the whole clock.
    """
    k = list(keys)
    frames = stream.select(*k, F.col(frame).cast("long").alias("f")).distinct()
    both = (
        marks.select("*", F.floor(F.col(mark)).cast("long").alias("f"), F.lit(1).alias("is_mark"))
        .unionByName(frames.withColumn("is_mark", F.lit(0)), allowMissingColumns=True)
        .withColumn("s", F.floor(F.col("f") / span))
    )
    up = Window.partitionBy(*k, "s").orderBy("f", "is_mark").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*k, "s").orderBy(F.desc("f"), F.desc("is_mark")).rowsBetween(Window.unboundedPreceding, 0)
    frame_only = F.when(F.col("is_mark") == 0, F.col("f"))
    both = both.withColumn("lower", F.last(frame_only, True).over(up)).withColumn("upper", F.last(frame_only, True).over(down)).where("is_mark = 1")
    # one row for each span of a clock
    extent = frames.groupBy(*k, F.floor(F.col("f") / span).alias("s")).agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    known = Window.partitionBy(*k).orderBy("s")
    fill = extent.join(both.select(*k, "s").distinct(), [*k, "s"], "full")
    fill = fill.select(*k, "s", F.max("hi").over(known.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min("lo").over(known.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    sides = both.join(fill, [*k, "s"]).withColumn("lower", F.coalesce("lower", "before")).withColumn("upper", F.coalesce("upper", "after")).drop("before", "after", "s", "is_mark")
    sides = sides.withColumn("upper", F.when(F.col("lower") == F.col(mark), F.col("lower")).otherwise(F.col("upper"))).drop("f")
    per = stream.groupBy(*k, F.col(frame).cast("long").alias("f"), hand).agg(F.max(value).alias("v"))
    out = sides.join(per.select(*k, F.col("f").alias("lower"), hand, F.col("v").alias("a")), [*k, "lower", hand]).join(per.select(*k, F.col("f").alias("upper"), hand, F.col("v").alias("b")), [*k, "upper", hand])
    if nearest:
        pick = F.when((F.col("upper") - F.col(mark)) <= (F.col(mark) - F.col("lower")), F.col("b")).otherwise(F.col("a"))
    else:
        part = F.when(F.col("upper") == F.col("lower"), F.lit(0.0)).otherwise((F.col(mark) - F.col("lower")) / (F.col("upper") - F.col("lower")))
        pick = (1 - part) * F.col("a") + part * F.col("b")
    return out.withColumn(value, pick).drop("a", "b")


def one_euro_step(
    state: tuple | None, t: int, x: np.ndarray, identity: str | None = None, fps: float = 25.0, min_cutoff: float = 1.5, beta: float = 0.3, derivative_cutoff: float = 1.0,
    min_alpha: float = 0.0, lengths: np.ndarray | None = None,
) -> tuple:
    """(t, identity, raw, filtered, slope, lengths) after one frame of points x (n, dimensions).
    A point's speed, itself smoothed, raises its own cutoff; a weight is `min_alpha` at least.
    `lengths`, such as a hand's bones, are drawn after at the lowest cutoff's weight, half of
    min_alpha at least. The filter starts anew after a gap in t, and where both frames have an
    identity and these differ."""

    def rate(cutoff):
        return 1 / (1 + fps / (2 * math.pi * cutoff))

    if state is None or state[0] != t - 1 or (identity and state[1] and identity != state[1]):
        return t, identity, x, x.copy(), np.zeros_like(x), lengths
    _, _, raw, out, slope, held = state
    a = rate(derivative_cutoff)
    slope = a * (x - raw) * fps + (1 - a) * slope
    a = np.maximum(rate(min_cutoff + beta * np.linalg.norm(slope, axis=1, keepdims=True)), min_alpha)
    if lengths is not None:
        b = max(rate(min_cutoff), 0.5 * min_alpha)
        lengths = b * lengths + (1 - b) * held
    return t, identity, x, a * x + (1 - a) * out, slope, lengths


def one_euro(df: DataFrame, keys: list[str], clock: str, values: list[str], identity: str | None = None, **how: float) -> DataFrame:
    """Adaptive low-pass over the point in `values`; see one_euro_step(). Streams in clock order,
    one state a series."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            x = frame[values].to_numpy(float)
            y = np.empty_like(x)
            names = frame[identity] if identity else [None] * len(frame)
            for i, (row, name) in enumerate(zip(frame[[*keys, clock]].itertuples(index=False), names, strict=True)):
                key, t = tuple(row[:-1]), row[-1]
                state = one_euro_step(state if key == now else None, t, x[i : i + 1], name, **how)
                now, y[i] = key, state[3][0]
            yield frame.assign(**{v: y[:, j] for j, v in enumerate(values)})

    extra = [identity] if identity else []
    rows = df.select(*keys, clock, *extra, *values).repartition(*keys).sortWithinPartitions(*keys, clock)
    return rows.mapInPandas(run, rows.schema)


def one_euro_bones(df: DataFrame, keys: list[str], clock: str, joints: str, bones: list[tuple[int, int]], **how: float) -> DataFrame:
    """Adaptive low-pass over hands (array column `joints` of points): the root and the bones as
    vectors are filtered each by its own speed, the bones' lengths by themselves, and the hand is
    built from both outwards from the root. A bone whose filtered vector has no length takes the
    frame's own direction."""
    parents, children = (np.array(side) for side in zip(*bones, strict=True))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for frame in frames:
            out = []
            for row, given in zip(frame[[*keys, clock]].itertuples(index=False), frame[joints], strict=True):
                key, t = tuple(row[:-1]), row[-1]
                p = np.stack([np.asarray(v, float) for v in given])
                x = np.vstack([p[:1], p[children] - p[parents]])
                state = one_euro_step(state if key == now else None, t, x, lengths=np.linalg.norm(x[1:], axis=1), **how)
                now, made = key, np.zeros_like(p)
                made[0] = state[3][0]
                for i, (parent, child) in enumerate(bones):
                    way = next((v for v in (state[3][i + 1], x[i + 1]) if np.linalg.norm(v) > 1e-8), None)
                    made[child] = made[parent] + (0 if way is None else way / np.linalg.norm(way) * state[5][i])
                out.append(made.tolist())
            yield frame.assign(**{joints: out})

    rows = df.select(*keys, clock, joints).repartition(*keys).sortWithinPartitions(*keys, clock)
    return rows.mapInPandas(run, rows.schema)


def propagated(df: DataFrame, keys: list[str], clock: str, keyframe: Column, score: str, decay: float = 0.98) -> DataFrame:
    """df with `age`, the frames since the series' last keyframe, and `carried`, that one's
    score times decay to the power of age; both null before the first keyframe."""
    w = Window.partitionBy(*keys).orderBy(clock).rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(clock))
    last = F.last(F.when(F.col("__key"), F.struct("__n", score)), ignorenulls=True).over(w)
    marked = df.withColumn("__key", keyframe).withColumn("__n", n).withColumn("__last", last)
    age = (F.col("__n") - F.col("__last.__n")).cast("long")
    return marked.withColumn("age", age).withColumn("carried", F.col("__last")[score] * F.pow(F.lit(decay), age)).drop("__key", "__n", "__last")


def smooth_rotations(df: DataFrame, keys: list[str], clock: str, axes: str, alpha: float) -> DataFrame:
    """df with the rotation matrix `axes` (rows of three doubles, whose first two span it)
    blended with the one before: alpha of its two leading axes and 1 - alpha of the smoothed
    ones before, made orthonormal. Streams in clock order; the first of a series stays."""

    def orthonormal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a = a / max(float(np.linalg.norm(a)), 1e-8)
        b = b - (a @ b) * a
        b = b / max(float(np.linalg.norm(b)), 1e-8)
        return np.stack([a, b, np.cross(a, b)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for frame in frames:
            out = []
            for row, given in zip(frame[keys].itertuples(index=False), frame[axes], strict=True):
                r = np.stack([np.asarray(v, float) for v in given])
                if tuple(row) == now:
                    mixed = alpha * r[:2] + (1 - alpha) * held[:2]
                    r = orthonormal(mixed[0], mixed[1])
                now, held = tuple(row), r
                out.append(r.tolist())
            frame[axes] = out
            yield frame

    rows = df.select(*keys, clock, axes).repartition(*keys).sortWithinPartitions(*keys, clock)
    return rows.mapInPandas(run, rows.schema)

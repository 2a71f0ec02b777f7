"""Camera corrections from many noisy poses, and how well views agree before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import vectors as V
from kinespark.sources.scratch import cut

from . import quantiles


def rotation_vector(r: Column) -> Column:
    """A rotation matrix (array of rows) as axis times angle, for angles under a half turn."""

    def vector(m: Column) -> Column:
        el = lambda i, j: V.at(V.at(m, i), j)
        skew = V.vec(el(2, 1) - el(1, 2), el(0, 2) - el(2, 0), el(1, 0) - el(0, 1))
        cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (el(0, 0) + el(1, 1) + el(2, 2) - 1) / 2))
        return V.let(F.struct(skew.alias("k"), F.acos(cosine).alias("a")), lambda s: V.scaled(s.k, F.when(F.sin(s.a) > 1e-9, s.a / (2 * F.sin(s.a))).otherwise(0.5)))

    return V.let(r, vector)


def rotation_matrix(v: Column) -> Column:
    """A rotation vector as a matrix (array of rows)."""

    def rows(s: Column) -> Column:
        c, n, k = F.cos(s.a), F.sin(s.a), [V.at(s.u, i) for i in range(3)]
        sign = {(0, 1): -k[2], (0, 2): k[1], (1, 0): k[2], (1, 2): -k[0], (2, 0): -k[1], (2, 1): k[0]}
        return F.array(*[V.vec(*[k[i] * k[j] * (1 - c) + (c if i == j else sign[i, j] * n) for j in range(3)]) for i in range(3)])

    return V.let(v, lambda w: V.let(F.struct(V.norm(w).alias("a"), F.when(V.norm(w) > 1e-12, V.scaled(w, 1 / V.norm(w))).otherwise(V.scaled(w, F.lit(0.0))).alias("u")), rows))


def _medians(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, one median for each of `names`), by one pass over all of them."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])).alias("e")).select(*keys, "e.*")
    found = quantiles.exact(long, [*keys, "name"], "v", {"m": 0.5})
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("m"))).alias(f"m_{n}") for n in names])


def robust_delta(df: DataFrame, keys: list[str], most_degrees: float, most_shift: float, least: int) -> DataFrame:
    """(keys, n, inliers, rx ry rz, tx ty tz): the median rotation vector and shift of the poses
    (rotation: rows, shift) that lie within both limits of the medians of all; null with fewer
    than `least` of them."""
    r = rotation_vector(F.col("rotation"))
    names = [*(f"r{a}" for a in "xyz"), *(f"t{a}" for a in "xyz")]
    rows = df.select(*keys, "rotation", "shift", *[V.at(r, i).alias(f"r{a}") for i, a in enumerate("xyz")], *[V.at(F.col("shift"), i).alias(f"t{a}") for i, a in enumerate("xyz")])
    middle = cut(_medians(rows, keys, names))  # one row a key
    joined = rows.join(middle, keys)
    turn = V.rotation_degrees(F.col("rotation"), rotation_matrix(V.vec(*[F.col(f"m_r{a}") for a in "xyz"])))
    away = V.norm(V.vec(*[F.col(f"t{a}") - F.col(f"m_t{a}") for a in "xyz"]))
    kept = joined.where((turn <= most_degrees) & (away <= most_shift)).select(*keys, *names)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).join(kept.groupBy(*keys).agg(F.count("*").alias("inliers")), keys, "left").withColumn("inliers", F.coalesce("inliers", F.lit(0)))
    again = counts.join(_medians(kept, keys, names), keys, "left")
    enough = F.col("inliers") >= least
    return again.select(*keys, "n", "inliers", *[F.when(enough, F.col(f"m_{c}")).alias(c) for c in names])


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, count, median, p95, mean)."""
    sums = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"))
    return sums.join(quantiles.exact(df, keys, value, {"median": 0.5, "p95": 0.95}), keys, "left")


def consistency(pairs: DataFrame, corrections: DataFrame) -> DataFrame:
    """(camera_id, measure, stage, count, mean, median, p95): distance of wrists and angle of
    rotations between two cameras' poses of one hand, with the cameras' own transforms and with
    the corrected ones. pairs: camera_id, reference, rotation, shift, ref_rotation, ref_shift;
    corrections: camera_id, raw_rotation, raw_shift, rotation, shift; a rig has few cameras."""
    own = F.broadcast(corrections.select("camera_id", *[F.col(c).alias(f"o_{c}") for c in ("raw_rotation", "raw_shift", "rotation", "shift")]))
    ref = F.broadcast(corrections.select(F.col("camera_id").alias("reference"), *[F.col(c).alias(f"r_{c}") for c in ("raw_rotation", "raw_shift", "rotation", "shift")]))
    joined = pairs.join(own, "camera_id").join(ref, "reference")

    def turned(a: Column, b: Column) -> Column:
        """The product of two matrices."""
        return V.let(b, lambda m: F.transform(a, lambda row: F.array(*[sum((V.at(row, k) * V.at(V.at(m, k), j) for k in range(3)), F.lit(0.0)) for j in range(3)])))

    def moved(r: Column, t: Column, p: Column) -> Column:
        return F.zip_with(V.rotated(r, p), t, lambda a, b: a + b)

    measures = []
    for stage, pre in (("before", "raw_"), ("after", "")):
        a = [F.col(f"o_{pre}rotation"), F.col(f"o_{pre}shift")]
        b = [F.col(f"r_{pre}rotation"), F.col(f"r_{pre}shift")]
        wrist = V.norm(V.sub(moved(*b, F.col("ref_shift")), moved(*a, F.col("shift"))))
        angle = V.rotation_degrees(turned(b[0], F.col("ref_rotation")), turned(a[0], F.col("rotation")))
        measures += [F.struct(F.lit("wrist").alias("measure"), F.lit(stage).alias("stage"), wrist.alias("v")), F.struct(F.lit("rotation").alias("measure"), F.lit(stage).alias("stage"), angle.alias("v"))]
    long = joined.select("camera_id", F.explode(F.array(*measures)).alias("m")).select("camera_id", "m.*")
    return summary(long, ["camera_id", "measure", "stage"], "v")

"""Rays of camera pixels in the rig's frame, and the points they agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions import vectors as V

from . import fit


def pixel_ray(x: Column, y: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """The unit ray of a pixel in its camera."""
    return V.unit(V.vec((x - cx) / fx, (y - cy) / fy, F.lit(1.0)))


def to_rig(rays: DataFrame, poses: DataFrame) -> DataFrame:
    """rays (camera_id, ray: a direction in the camera) as origins and unit directions in the
    rig's frame: ox oy oz dx dy dz. poses: camera_id, origin, rotation (rows, camera to rig); a
    rig has few cameras. Rays of cameras without a pose, and those without a length, go."""
    joined = rays.join(F.broadcast(poses.select("camera_id", "origin", "rotation")), "camera_id")
    turned = joined.withColumn("__d", V.unit(V.rotated(F.col("rotation"), V.unit(F.col("ray"))))).where(V.norm(F.col("__d")) > 0.5)
    ends = {f"o{a}": V.at(F.col("origin"), i) for i, a in enumerate("xyz")} | {f"d{a}": V.at(F.col("__d"), i) for i, a in enumerate("xyz")}
    return turned.withColumns(ends).drop("__d", "origin", "rotation")


def _apart(rays: DataFrame, p: Column) -> Column:
    """Distance of the point p from a ray with a unit direction."""
    off = [V.at(p, i) - F.col(f"o{a}") for i, a in enumerate("xyz")]
    foot = sum((o * F.col(f"d{a}") for o, a in zip(off, "xyz", strict=True)), F.lit(0.0))
    return F.sqrt(sum(((o - foot * F.col(f"d{a}")) * (o - foot * F.col(f"d{a}")) for o, a in zip(off, "xyz", strict=True)), F.lit(0.0)))


def gated(rays: DataFrame, primary: Column, most: float) -> DataFrame:
    """rays (with `seed` and `before`, points or null) with `accepted`: rays of the primary camera,
    those without a point to compare with, and those within `most` of the seed, or of the point
    before where there is no seed."""
    reference = F.coalesce("seed", "before")
    far = F.coalesce(_apart(rays, reference) > most, F.lit(False))
    return rays.withColumn("accepted", (F.col("camera_id") == primary) | ~far)


def initial_points(rays: DataFrame, keys: list[str], primary: Column) -> DataFrame:
    """(keys, joint, point): where each point of a hand starts, from accepted rays. The seed, else
    the point nearest to its rays if there are two or more, else the point before, else the
    wrist's with the way from the wrist before. A wrist without any of these takes the point
    before where the primary camera sees it. rays: gated() with `seed`, `before` and `root_before`
    (the point from the wrist before)."""
    by = [*keys, "joint"]
    good = rays.where("accepted")
    met = fit.triangulate(good, by).where("views >= 2").select(*by, V.vec(F.col("x"), F.col("y"), F.col("z")).alias("met"))
    known = rays.groupBy(*by).agg(F.first("seed", True).alias("seed"), F.first("before", True).alias("before"), F.first("root_before", True).alias("root_before"), F.max(F.col("accepted").cast("int")).alias("seen"), F.max((F.col("camera_id") == primary).cast("int")).alias("main"))
    joined = known.join(met, by, "left")
    first = F.coalesce("seed", "met", F.when(F.col("seen") == 1, F.col("before")))
    joined = joined.withColumn("point", F.when((F.col("joint") == 0) & first.isNull() & (F.col("main") == 1), F.col("before")).otherwise(first))
    wrist = F.max(F.when(F.col("joint") == 0, F.col("point"))).over(Window.partitionBy(*keys))
    joined = joined.withColumn("__w", wrist)
    moved = F.zip_with("__w", "root_before", lambda a, b: a + b)
    return joined.select(*by, F.coalesce("point", moved).alias("point")).where("point is not null")


def joint_states(points: DataFrame, rays: DataFrame, keys: list[str], primary: Column, mean: float, most: float) -> DataFrame:
    """(keys, joint, mode, valid, metric_valid, views, rejected, mean_error, max_error) of each
    point: metric if the primary camera and another see it within the limits, a fallback if the
    primary does, else rejected or missing."""
    by = [*keys, "joint"]
    joined = rays.join(points.select(*by, "point"), by, "left")
    off = F.when(F.col("accepted"), _apart(joined, F.col("point")))
    main = F.max((F.col("accepted") & (F.col("camera_id") == primary)).cast("int")) == 1
    other = F.max((F.col("accepted") & (F.col("camera_id") != primary)).cast("int")) == 1
    found = joined.groupBy(*by).agg(
        F.first("point", True).alias("point"), main.alias("main"), other.alias("other"), F.count_if("accepted").alias("views"),
        F.count_if(~F.col("accepted")).alias("rejected"), F.avg(off).alias("mean_error"), F.max(off).alias("max_error"),
    )
    has = F.col("point").isNotNull()
    metric = has & F.col("main") & F.col("other") & (F.col("mean_error") <= mean) & (F.col("max_error") <= most)
    mode = F.when(F.coalesce(metric, F.lit(False)), "metric").when(has & F.col("main"), "fallback").when(F.col("rejected") > 0, "rejected").otherwise("missing")
    out = found.withColumn("mode", mode).withColumn("valid", F.col("mode").isin("metric", "fallback")).withColumn("metric_valid", F.col("mode") == "metric")
    return out.select(*by, "mode", "valid", "metric_valid", "views", "rejected", *[F.when(F.col("metric_valid"), F.col(c)).alias(c) for c in ("mean_error", "max_error")])


def edge_length(points: Column, before: Column, a: int, b: int) -> Column:
    """Length of an edge: that of the hand before where both its ends are there, else this one's."""
    return F.coalesce(V.norm(V.sub(F.get(before, F.lit(a)), F.get(before, F.lit(b)))), V.norm(V.sub(F.get(points, F.lit(a)), F.get(points, F.lit(b)))))


def perspective(p: Column, shift: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pixel of a camera point moved by `shift`; depths count as 1e-5 at least."""
    return V.let(F.zip_with(p, shift, lambda a, b: a + b), lambda q: V.vec(fx * V.at(q, 0) / F.greatest(V.at(q, 2), F.lit(1e-5)) + cx, fy * V.at(q, 1) / F.greatest(V.at(q, 2), F.lit(1e-5)) + cy))


def to_camera(p: Column, rotation: Column, shift: Column) -> Column:
    """A point of a hand's frame in the camera's."""
    return F.zip_with(V.rotated(rotation, p), shift, lambda a, b: a + b)

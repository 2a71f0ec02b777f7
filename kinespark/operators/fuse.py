"""Fusion of several views of a hand into one, in long form (keys, camera_id, joint, x, y, z)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from kinespark.functions import vectors as V

from . import quantiles

#: The 20 bones of a hand as (parent, child) of its 21 points.
BONES = [
    (0, 1), (1, 2), (2, 3), (3, 4), (0, 5), (5, 6), (6, 7), (7, 8), (0, 9), (9, 10),
    (10, 11), (11, 12), (0, 13), (13, 14), (14, 15), (15, 16), (0, 17), (17, 18), (18, 19), (19, 20),
]
#: Fixed value: the least weight of a view.
FLOOR = 0.05
KEYS = ["sequence_id", "group_id", "hand"]


def root_relative(h: DataFrame) -> DataFrame:
    """h (with `joints`) with every point from the wrist."""
    wrist = F.get("joints", F.lit(0))
    return h.withColumn("joints", F.transform("joints", lambda p: F.zip_with(p, wrist, lambda a, b: a - b)))


def mean_views(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean point over the cameras, population deviation and number of views."""
    at = [F.avg(c).alias(c) for c in "xyz"]
    spread = F.sqrt(F.greatest(F.lit(0.0), F.var_pop("x") + F.var_pop("y") + F.var_pop("z"))).alias("spread")
    return rows.groupBy(*keys, "joint").agg(*at, spread, F.count("*").alias("views"))


def weighted_views(rows: DataFrame, keys: list[str] = KEYS, quality: str = "quality") -> DataFrame:
    """Mean weighted by quality, at least FLOOR for each view."""
    w = F.greatest(F.col(quality), F.lit(FLOOR))
    return rows.groupBy(*keys, "joint").agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in "xyz"], F.count("*").alias("views"))


def medoid_views(rows: DataFrame, keys: list[str] = KEYS, quality: str = "quality") -> DataFrame:
    """The camera of each key whose points have the least weighted mean distance to the other
    views'; ties by higher weight, then camera id. A key has a camera once, so the pairs of a
    key are bounded by the cameras."""
    other = rows.select(*keys, "joint", F.col("camera_id").alias("other"), F.greatest(F.col(quality), F.lit(FLOOR)).alias("w"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    apart = F.sqrt(sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "xyz"), F.lit(0.0)))
    pairs = rows.join(other, [*keys, "joint"]).groupBy(*keys, "camera_id", "other").agg(F.avg(apart).alias("d"), F.max("w").alias("w"), F.max(quality).alias("q"))
    cost = pairs.groupBy(*keys, "camera_id").agg((F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("cost"), F.max("q").alias("q"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("cost", 9), F.desc("q"), "camera_id"))
    return cost.withColumn("r", rank).where("r = 1").select(*keys, "camera_id", "cost")


def bone_rows(h: DataFrame) -> DataFrame:
    """(all but joints, bone, length) for each hand."""

    def length(a: Column, b: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))

    lengths = F.array(*[length(F.get("joints", F.lit(a)), F.get("joints", F.lit(b))) for a, b in BONES])
    return h.select(*[c for c in h.columns if c != "joints"], F.posexplode(lengths).alias("bone", "length"))


def static_bones(h: DataFrame, least: int = 3) -> DataFrame:
    """Median over the cameras of each camera's median bone length, of cameras with at least
    `least` observations."""
    rows, by = bone_rows(h), ["hand", "camera_id", "bone"]
    seen = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    own = quantiles.exact(rows, by, "length", {"m": 0.5}).join(seen, by)
    # a rig has few cameras, so this median holds few values
    return own.groupBy("hand", "bone").agg(F.median("m").alias("length"), F.count("*").alias("cameras"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The least value at which the running weight reaches half of the key's; a weight is 1e-8
    at least."""
    w, own = Window.partitionBy(*keys), F.greatest(F.col(weight), F.lit(1e-8))
    run = F.sum(own).over(w.orderBy(value, weight).rowsBetween(Window.unboundedPreceding, 0))
    marked = df.withColumn("__run", run).withColumn("__all", F.sum(own).over(w))
    return marked.where(F.col("__run") >= 0.5 * F.col("__all")).groupBy(*keys).agg(F.min(value).alias(value))


def with_static_bones(h: DataFrame, lengths: DataFrame, blend: float) -> DataFrame:
    """h (joints from the wrist) with its bones drawn towards `lengths` (hand, bone, length)
    by blend, from the wrist outwards; a bone without length stays where it was, and so do
    hands without lengths. The lengths are twenty rows a hand."""
    table = lengths.groupBy("hand").agg(F.map_from_entries(F.collect_list(F.struct("bone", "length"))).alias("__length"))
    parents = F.array(*[F.lit(a) for a, _ in BONES])

    def placed(out: Column, bone: Column) -> Column:
        parent = F.get(parents, bone)
        a, b = F.get("joints", parent), F.get("joints", bone + 1)
        size = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (y - x) * (y - x)), F.lit(0.0), lambda s, v: s + v))
        grow = 1 - blend + blend * F.try_element_at("__length", bone) / size
        moved = F.zip_with(F.get(out, parent), F.zip_with(a, b, lambda x, y: (y - x) * grow), lambda x, y: x + y)
        return F.concat(out, F.array(F.when(size > 1e-8, moved).otherwise(b)))

    # bone i ends in joint i + 1, so joints come in order
    start = F.array(F.transform(F.get("joints", F.lit(0)), lambda x: x * 0.0))
    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(len(BONES) - 1)), start, placed)
    return h.join(F.broadcast(table), "hand", "left").withColumn("joints", F.when(F.size("__length") == len(BONES), drawn).otherwise(F.col("joints"))).drop("__length")


@F.pandas_udf(DoubleType())
def aligned_error(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean distance of the points of two hands after the best rotation and shift of a to b."""
    if not len(a):
        return pd.Series([], dtype=float)
    p, q = (np.stack([np.stack(list(v)) for v in side]).astype(float) for side in (a, b))
    p, q = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
    u, _, vt = np.linalg.svd(np.einsum("nki,nkj->nij", p, q))
    flip = np.ones((len(p), 3))
    flip[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    turned = np.einsum("nki,nij->nkj", p, (u * flip[:, None, :]) @ vt)
    return pd.Series(np.linalg.norm(turned - q, axis=2).mean(axis=1))


def consensus_errors(h: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, camera_id, error): the median of a camera's aligned errors to the key's other
    cameras; null for one that is alone. Pairs within a key are bounded by the cameras."""
    one = h.select(*keys, "camera_id", "joints")
    other = one.select(*keys, F.col("camera_id").alias("other"), F.col("joints").alias("__joints"))
    pairs = one.join(other, keys).where("camera_id < other").select(*keys, "camera_id", "other", aligned_error("joints", "__joints").alias("error"))
    ends = pairs.select(*keys, F.explode(F.array("camera_id", "other")).alias("camera_id"), "error")
    return one.drop("joints").join(ends.groupBy(*keys, "camera_id").agg(F.median("error").alias("error")), [*keys, "camera_id"], "left")


def camera_report(rows: DataFrame, most: float, keys: list[str] = KEYS) -> DataFrame:
    """One row a camera: its hands, those whose mean distance to the fused hand is at most
    `most` (accepted) and the rest, and the mean, median and greatest distance."""
    fused = mean_views(rows, keys).select(*keys, "joint", *[F.col(c).alias(f"f{c}") for c in "xyz"])
    apart = F.sqrt(sum(((F.col(c) - F.col(f"f{c}")) * (F.col(c) - F.col(f"f{c}")) for c in "xyz"), F.lit(0.0)))
    each = rows.join(fused, [*keys, "joint"]).groupBy(*keys, "camera_id").agg(F.avg(apart).alias("error"))
    accepted = F.count_if(F.col("error") <= most)
    report = each.groupBy("camera_id").agg(
        F.count("*").alias("hands"), accepted.alias("accepted"), (F.count("*") - accepted).alias("rejected"), F.avg("error").alias("mean"), F.max("error").alias("max")
    )
    return report.join(quantiles.exact(each, ["camera_id"], "error", {"median": 0.5}), "camera_id")


def _turned(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    p, q = (np.stack([np.stack(list(v)) for v in side]).astype(float) for side in (a, b))
    pm, qm = p.mean(axis=1, keepdims=True), q.mean(axis=1, keepdims=True)
    u, _, vt = np.linalg.svd(np.einsum("nki,nkj->nij", p - pm, q - qm))
    flip = np.ones((len(p), 3))
    flip[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    moved = np.einsum("nki,nij->nkj", p - pm, (u * flip[:, None, :]) @ vt) + qm
    return moved, np.linalg.norm(moved - q, axis=2).mean(axis=1)


@F.pandas_udf(StructType([StructField("points", ArrayType(ArrayType(DoubleType()))), StructField("error", DoubleType())]))
def aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """a's points turned and shifted onto b's, and the mean distance left."""
    if not len(a):
        return pd.DataFrame({"points": pd.Series([], dtype=object), "error": pd.Series([], dtype=float)})
    moved, error = _turned(a, b)
    return pd.DataFrame({"points": [m.tolist() for m in moved], "error": error})


def build_targets(h: DataFrame, keys: list[str], most: float) -> DataFrame:
    """(keys, anchor, used, target): each key's view of best quality (ties by camera), and the mean
    of it and of those views that lie within `most` of it once aligned, weighted by quality (1e-3
    at least), in the palm frame. Only the anchor meets the other views, never all pairs."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("quality"), "camera_id"))
    ranked = h.withColumn("__r", rank)
    anchor = ranked.where("__r = 1").select(*keys, F.col("camera_id").alias("anchor"), F.col("joints").alias("__a"))
    joined = ranked.join(anchor, keys).withColumn("__m", aligned("joints", "__a"))
    own = F.col("camera_id") == F.col("anchor")
    good = joined.where(own | (F.col("__m.error") <= most)).withColumn("__p", V.palm_local(F.when(own, F.col("joints")).otherwise(F.col("__m.points")))).where("__p is not null")
    w = F.greatest("quality", F.lit(1e-3))
    points = good.select(*keys, "anchor", w.alias("w"), F.posexplode("__p").alias("joint", "p"))
    means = points.groupBy(*keys, "anchor", "joint").agg(F.count("*").alias("used"), *[(F.sum(F.col("w") * V.at(F.col("p"), i)) / F.sum("w")).alias(a) for i, a in enumerate("xyz")])
    return means.groupBy(*keys, "anchor", "used").agg(F.array_sort(F.collect_list(F.struct("joint", F.array("x", "y", "z").alias("p")))).alias("t")).withColumn("target", F.col("t.p")).drop("t")

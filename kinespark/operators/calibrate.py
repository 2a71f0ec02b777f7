"""Calibration of predicted hands to true ones: a similarity, bone scales and joint offsets; a
residual model on pose features; and shifts or scales of projected pixels. Each is fitted on
aggregates, kept as a small profile that can be saved and loaded, and applied to tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.functions import vectors as V

from . import evaluate, fit
from .fuse import BONES, bone_rows

#: Points of a hand.
POINTS = 21
FIT_JOINTS = [0, *range(2, POINTS)]


def _identity() -> dict:
    return {"scale": 1.0, "rotation": np.eye(3).tolist(), "translation": [0.0] * 3, "bone_scales": [1.0] * len(BONES), "offsets": [[0.0] * 3] * POINTS, "status": "identity"}


def _long(pairs: DataFrame) -> DataFrame:
    """(hand, joint, x y z, tx ty tz) of pairs (hand, joints, truth)."""
    both = F.arrays_zip("joints", "truth")
    rows = pairs.select("hand", F.posexplode(both).alias("joint", "p"))
    return rows.select("hand", "joint", *[V.at(F.col("p.joints"), i).alias(a) for i, a in enumerate("xyz")], *[V.at(F.col("p.truth"), i).alias(f"t{a}") for i, a in enumerate("xyz")])


def fit_profile(
    pairs: DataFrame, joints: list[int] | None = None, least_pairs: int = 200, scale: bool = True, shift: bool = False, bones: bool = True, offsets: bool = True,
    bone_k: float = 100.0, low: float = 0.7, high: float = 1.3, offset_k: float = 200.0, most_offset: float = 0.03,
) -> dict[str, dict]:
    """A profile for each hand from pairs (hand, joints, truth): the similarity of the points
    `joints` (identity with fewer than `least_pairs` points), then the scales of the bones it
    leaves, then the offsets of the joints both leave. What comes to the driver is a row of
    moments, 20 scales and 21 offsets a hand."""
    joints = FIT_JOINTS if joints is None else joints
    long = _long(pairs).where(F.col("joint").isin(*joints))
    profile = {}
    for row in fit.similarity_moments(long, ["hand"]).collect():  # one row a hand
        own = _identity() | {"pairs": row["n"]}
        if row["n"] >= least_pairs:
            s, r, t = fit.similarity(row.asDict(), scale, shift)
            own |= {"scale": float(s), "rotation": r.tolist(), "translation": t.tolist(), "status": "estimated_similarity"}
        profile[row["hand"]] = own
    if bones and profile:
        moved = apply_profile(pairs, profile)
        lengths = bone_rows(moved.select(F.monotonically_increasing_id().alias("id"), "hand", "joints", "truth"))
        both = lengths.withColumn("true_length", _bone_length(F.col("truth"), F.col("bone")))
        for r in fit.bone_scales(both, bone_k, low, high, ["hand"]).collect():
            profile[r["hand"]]["bone_scales"][r["bone"]] = r["scale"]
    if offsets and profile:
        rest = _long(apply_profile(pairs, profile)).where(F.col("joint").isin(*joints))
        for hand in profile:
            found = {r["joint"]: [r["x"], r["y"], r["z"]] for r in fit.joint_offsets(rest.where(F.col("hand") == hand), offset_k, most_offset).collect()}
            profile[hand]["offsets"] = [found.get(j, [0.0] * 3) for j in range(POINTS)]
    return profile


def _bone_length(joints: Column, bone: Column) -> Column:
    parents, children = (F.array(*[F.lit(b[i]) for b in BONES]) for i in (0, 1))
    return V.norm(V.sub(F.get(joints, F.get(children, bone)), F.get(joints, F.get(parents, bone))))


def with_bone_scales(joints: Column, scales: Column) -> Column:
    """joints with every bone's vector times its scale, built outwards from the wrist."""
    parents = F.array(*[F.lit(a) for a, _ in BONES])

    def placed(out: Column, bone: Column) -> Column:
        way = V.scaled(V.sub(F.get(joints, bone + 1), F.get(joints, F.get(parents, bone))), F.get(scales, bone))
        return F.concat(out, F.array(F.zip_with(F.get(out, F.get(parents, bone)), way, lambda a, b: a + b)))

    # bone i ends in joint i + 1, so joints come in order
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(BONES) - 1)), F.slice(joints, 1, 1), placed)


def apply_profile(h: DataFrame, profile: dict[str, dict], recentre: bool = False) -> DataFrame:
    """h (hand, joints) under its hand's profile: similarity, bone scales, offsets, and from the
    wrist again if asked. Hands without a profile stay as they are."""

    def literal(v) -> Column:
        return F.array(*[literal(x) for x in v]) if isinstance(v, list) else F.lit(float(v))

    def corrected(own: dict) -> Column:
        turn, shift = literal((np.array(own["rotation"]) * own["scale"]).tolist()), literal(own["translation"])
        moved = F.transform("joints", lambda p: F.zip_with(V.rotated(turn, p), shift, lambda a, b: a + b))
        scaled = V.let(moved, lambda j: with_bone_scales(j, literal(own["bone_scales"])))
        final = F.zip_with(scaled, literal(own["offsets"]), lambda p, o: F.zip_with(p, o, lambda a, b: a + b))
        return V.let(final, lambda j: F.transform(j, lambda p: V.sub(p, F.get(j, F.lit(0))))) if recentre else final

    out = F.col("joints")
    for hand, own in profile.items():
        out = F.when(F.col("hand") == hand, corrected(own)).otherwise(out)
    return h.withColumn("joints", out)


def save(profile: dict, path: str) -> None:
    """A profile as JSON on the driver; it is a few kilobytes."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"profile": {k: {n: v.tolist() if isinstance(v, np.ndarray) else v for n, v in own.items()} for k, own in profile.items()}}, f)


def load(path: str, hands: tuple[str, ...] = ("Left", "Right")) -> dict[str, dict]:
    """The saved profile with the identity for hands it lacks; an error where a part has another
    shape."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)["profile"]
    profile = {h: _identity() | given.get(h, {}) for h in hands}
    for h, own in profile.items():
        shapes = {"rotation": (3, 3), "translation": (3,), "bone_scales": (len(BONES),), "offsets": (POINTS, 3)}
        if wrong := [n for n, shape in shapes.items() if np.shape(own[n]) != shape]:
            raise ValueError(f"{wrong} of {h} have another shape")
    return profile


def split_parity(pairs: DataFrame, group: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """(even groups to fit on, odd ones to test on)."""
    return pairs.where(F.col(group) % 2 == 0), pairs.where(F.col(group) % 2 != 0)


def errors(pairs: DataFrame) -> DataFrame:
    """(hand, n, mean, median, rmse, p90, p95, max) of the distances between joints and truth."""
    d = F.transform(F.arrays_zip("joints", "truth"), lambda e: V.norm(V.sub(e["joints"], e["truth"])))
    return evaluate.statistics(pairs.select("hand", F.explode(d).alias("error")), ["hand"], "error")


def features(h: DataFrame, mode: str, keys: list[str], clock: str) -> DataFrame:
    """h (keys, clock, joints) with `features`: "all-joints": points from the wrist;
    "all-joints-velocity": these and half the difference of the neighbours one tick away (a
    missing one counts as the row); "fingertip-summary": tips, bases and their distances."""
    wrist = F.get("joints", F.lit(0))
    local = F.transform("joints", lambda p: V.sub(p, wrist))
    rows = h.withColumn("__p", local)
    if mode == "all-joints":
        return rows.withColumn("features", F.flatten("__p")).drop("__p")
    if mode == "all-joints-velocity":
        near = rows.select(*keys, F.col(clock).alias("__t"), F.col("__p").alias("__n"))
        before = near.select(*keys, (F.col("__t") + 1).alias(clock), F.col("__n").alias("__b"))
        after = near.select(*keys, (F.col("__t") - 1).alias(clock), F.col("__n").alias("__a"))
        both = rows.join(before, [*keys, clock], "left").join(after, [*keys, clock], "left")
        step = F.zip_with(F.coalesce("__a", "__p"), F.coalesce("__b", "__p"), lambda a, b: F.zip_with(a, b, lambda x, y: 0.5 * (x - y)))
        return both.withColumn("features", F.flatten(F.concat("__p", step))).drop("__p", "__a", "__b")
    if mode == "fingertip-summary":
        pick = lambda ids: F.array(*[F.get("__p", F.lit(i)) for i in ids])
        tips, bases = pick((4, 8, 12, 16, 20)), pick((2, 5, 9, 13, 17))
        sizes = lambda a: F.transform(a, V.norm)
        return rows.withColumn("features", F.concat(F.flatten(tips), F.flatten(bases), sizes(tips), sizes(bases))).drop("__p")
    raise ValueError(f"no such features: {mode}")


def _standard(model: dict):
    mean, deviation = (np.array(model[c]) for c in ("mean", "deviation"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(mean), pa.int32()), pa.array(((x - mean) / deviation).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "features"), flat], [*(c for c in batch.schema.names if c != "features"), "features"])

    return run


def _linear(model: dict):
    weights, intercept = np.array(model["weights"]), np.array(model["intercept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = x @ weights + intercept
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "linear"])

    return run


def standardised(rows: DataFrame, model: dict) -> DataFrame:
    """rows (id, features, ...) with features as the model saw them: mean 0 and deviation 1."""
    names = [c for c in rows.columns if c != "features"]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names), "features array<double>"])
    return rows.select(*names, F.col("features").cast("array<double>").alias("features")).mapInArrow(_standard(model), schema)


def fit_residual(train: DataFrame, alpha: float = 1.0) -> tuple[dict, DataFrame, DataFrame]:
    """(model, prototypes, nearest) of one hand from rows (id, features, residual), where residual
    is the flat true less predicted points: a ridge regression on standardised features; the
    standardised rows, which stay a table; and the distance of each to its nearest other one."""
    first = train.select(F.size("features").alias("d"), F.size("residual").alias("w")).first()
    mean, deviation, weights, intercept = fit.ridge(train, "features", "residual", first["d"], alpha, first["w"])
    model = {"mean": mean.tolist(), "deviation": deviation.tolist(), "weights": weights.tolist(), "intercept": intercept.tolist()}
    prototypes = standardised(train.select("id", "residual", "features"), model)
    nearest = fit.knn(prototypes, prototypes, "features", "residual", 1).select("id", "nearest")
    return model, prototypes, nearest


def residual_correction(
    rows: DataFrame, model: dict, prototypes: DataFrame, nearest: DataFrame, k: int = 8, bandwidth: float = 1.0, blend: float = 0.5, shrink: float = 1.0, most: float = 0.0,
    full: float = 0.75, zero: float = 0.99, least_gate: float = 0.0,
) -> DataFrame:
    """(id, correction, gate, nearest) for rows (id, features): `blend` of the mean of the k nearest
    training rows' residuals and 1 - blend of the regression's (0: the regression alone, 1: the
    neighbours alone), times `shrink` and a gate that closes far from the training rows, as 21
    points none longer than `most` (0: no limit). A row of the training table isn't its own
    neighbour, so its correction is what it gets left out."""
    norm = standardised(rows.select("id", "features"), model)
    linear = norm.mapInArrow(_linear(model), "id long, linear array<double>")
    near = fit.knn(norm, prototypes, "features", "residual", k, bandwidth)
    gated = fit.ood_gate(near, "nearest", nearest, full, zero, least_gate).join(linear, "id")
    both = F.zip_with("linear", "predicted", lambda a, b: ((1 - blend) * a + blend * b) * (F.lit(shrink) * F.col("gate")))
    points = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.slice("__v", i * 3 + 1, 3))
    cut = F.transform(points, lambda p: V.scaled(p, F.least(F.lit(1.0), F.lit(most) / F.greatest(V.norm(p), F.lit(1e-12))))) if most > 0 else points
    return gated.withColumn("__v", both).select("id", cut.alias("correction"), "gate", "nearest")


def save_residual(model: dict, prototypes: DataFrame, nearest: DataFrame, path: str) -> None:
    """A residual model: its coefficients as one JSON record, the rest as Parquet."""
    prototypes.join(nearest, "id").write.parquet(f"{path}/prototypes")
    prototypes.sparkSession.createDataFrame([(json.dumps(model),)], "model string").coalesce(1).write.parquet(f"{path}/model")


def load_residual(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{path}/prototypes")
    model = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
    return model, rows.select("id", "residual", "features"), rows.select("id", "nearest")


def pixel_pairs(views: DataFrame, width: float, height: float, most: float, least: int = 6) -> DataFrame:
    """(camera_id, x, y, tx, ty): projected pixels with those seen, of views (id, projections: a
    map of camera to structs `projected` and `seen`, arrays of pixels) with `least` points or
    more; the projected within a quarter of the image around it, the seen inside it, and no
    further apart than `most`."""
    each = views.select("id", F.explode("projections").alias("camera_id", "v"))
    n = F.least(F.size("v.projected"), F.size("v.seen"), F.lit(POINTS))
    flat = lambda name: F.coalesce(F.forall(F.col(name), lambda p: (F.size(p) >= 2) & V.finite(F.slice(p, 1, 2))), F.lit(False))
    good = each.where((n >= least) & flat("v.projected") & flat("v.seen")).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    at = lambda name, k: V.at(F.get(F.col(name), F.col("i")), k)
    rows = good.select("camera_id", at("v.projected", 0).alias("x"), at("v.projected", 1).alias("y"), at("v.seen", 0).alias("tx"), at("v.seen", 1).alias("ty"))
    c = F.col
    near = c("x").between(-width * 0.25, width * 1.25) & c("y").between(-height * 0.25, height * 1.25)
    inside = (c("tx") >= 0) & (c("tx") < width) & (c("ty") >= 0) & (c("ty") < height)
    return rows.where(near & inside & (F.hypot(c("x") - c("tx"), c("y") - c("ty")) <= most))


def pixel_corrections(pairs: DataFrame, mode: str = "translation", least_points: int = 50, gain: float = 0.0, **how: float) -> DataFrame:
    """(camera_id, points, ax, bx, ay, by, status, before, after): each camera's correction of its
    pixels, the identity with fewer than `least_points` points or where the mean distance doesn't
    fall by more than `gain`. Only sums by camera are joined back; cameras are few."""
    if mode == "translation":
        found = fit.huber_shift(pairs, ["camera_id"], **how).select("camera_id", F.lit(1.0).alias("ax"), F.col("sx").alias("bx"), F.lit(1.0).alias("ay"), F.col("sy").alias("by"))
    else:
        found = fit.axis_affine(pairs, ["camera_id"], **how)
    moved = pairs.join(F.broadcast(found), "camera_id")
    apart = lambda x, y: F.hypot(x - F.col("tx"), y - F.col("ty"))
    means = moved.groupBy("camera_id").agg(
        F.count("*").alias("points"), F.avg(apart(F.col("x"), F.col("y"))).alias("before"),
        F.avg(apart(F.col("ax") * F.col("x") + F.col("bx"), F.col("ay") * F.col("y") + F.col("by"))).alias("__after"),
    )
    few, worse = F.col("points") < least_points, F.col("__after") > F.col("before") - gain
    status = F.when(worse & ~few, "identity_no_reliable_improvement").when(few, "insufficient_points").otherwise(f"estimated_{mode}")
    kept = ~few & ~worse
    out = means.join(found, "camera_id").withColumn("status", status)
    names = {"ax": 1.0, "bx": 0.0, "ay": 1.0, "by": 0.0}
    return out.select("camera_id", "points", *[F.when(kept, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in names.items()], "status", "before", F.when(kept, F.col("__after")).otherwise(F.col("before")).alias("after"))


def memory_gate(peaks: DataFrame, budget: float) -> DataFrame:
    """One row (workers, peak): the sum of the workers' peaks; an error when one is missing or the
    sum is over the budget. peaks: worker, peak."""
    total = peaks.agg(F.count("*").alias("workers"), F.count("peak").alias("__known"), F.sum("peak").alias("peak"))
    fault = F.when(F.col("__known") < F.col("workers"), F.raise_error(F.lit("a worker has no peak"))).when(F.col("peak") > budget, F.raise_error(F.lit("over the memory budget")))
    return total.withColumn("peak", F.coalesce(fault.cast("double"), F.col("peak"))).drop("__known")

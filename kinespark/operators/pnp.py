"""Pose of a body from the pixels of its points, for many bodies at once: linear starts, then a
damped Gauss-Newton on rotation and shift; and what follows for the cameras that saw them.

Starts are the four-control-point method, whose null space is resolved in three ways, and a scaled
orthographic view with its mirror, which holds for flat bodies. All are refined, the one that
leaves the least pixels counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinespark.functions import vectors as V
from kinespark.sources.scratch import cut

from . import poses


#: Points that a pose needs, its least depth, and the confidence a point needs.
LEAST, DEPTH, CONFIDENCE = 6, 1e-4, 1e-4
ROUNDS = 40


def _turned(v: np.ndarray) -> np.ndarray:
    """Rotation matrices (n, 3, 3) of rotation vectors (n, 3)."""
    size = np.sqrt((v * v).sum(axis=1))
    k = v / np.maximum(size, 1e-300)[:, None]
    z = np.zeros(len(v))
    cross = np.stack([z, -k[:, 2], k[:, 1], k[:, 2], z, -k[:, 0], -k[:, 1], k[:, 0], z], axis=1).reshape(-1, 3, 3)
    s, c = np.sin(size)[:, None, None], np.cos(size)[:, None, None]
    return np.eye(3) + s * cross + (1 - c) * (cross @ cross)


def _nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    flip = np.ones((len(m), 3))
    flip[:, 2] = np.sign(np.linalg.det(u @ vt))
    return (u * flip[:, None]) @ vt


def _fitted(body: np.ndarray, camera: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and shifts that take the points of bodies (n, p, 3) to those in the camera."""
    w = on[..., None] / on.sum(axis=1)[:, None, None]
    a, b = (body * w).sum(axis=1), (camera * w).sum(axis=1)
    r = _nearest_rotation(np.einsum("npi,npj->nij", (camera - b[:, None]) * w, body - a[:, None]))
    return r, b - np.einsum("nij,nj->ni", r, a)


def _control_starts(body: np.ndarray, seen: np.ndarray, on: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Poses by four control points (centre and principal axes): the points' shares of the control
    points are the same in the camera, which makes the views linear in twelve numbers."""
    n = len(body)
    w = on[..., None] / on.sum(axis=1)[:, None, None]
    centre = (body * w).sum(axis=1)
    away = (body - centre[:, None]) * on[..., None]
    values, axes = np.linalg.eigh(np.einsum("npi,npj->nij", away, away) / on.sum(axis=1)[:, None, None])
    length = np.sqrt(np.maximum(values, 1e-12 * np.maximum(values[:, 2:], 1e-300)))
    control = np.concatenate([centre[:, None], centre[:, None] + (axes * length[:, None]).transpose(0, 2, 1)], axis=1)
    share = np.einsum("npi,nik->npk", away, axes) / length[:, None]
    alpha = np.concatenate([1 - share.sum(axis=2, keepdims=True), share], axis=2) * on[..., None]
    zero = np.zeros_like(alpha)
    rows = np.concatenate([np.stack([alpha, zero, -alpha * seen[..., :1]], axis=-1), np.stack([zero, alpha, -alpha * seen[..., 1:]], axis=-1)], axis=1).reshape(n, -1, 12)
    kernel = np.linalg.eigh(rows.transpose(0, 2, 1) @ rows)[1][:, :, :4].transpose(0, 2, 1).reshape(n, 4, 4, 3)
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    i, j = np.array(pairs).T
    d = kernel[:, :, i] - kernel[:, :, j]  # (n, 4, 6, 3)
    rho = ((control[:, i] - control[:, j]) ** 2).sum(axis=-1)
    product = np.einsum("nape,nbpe->npab", d, d)
    column = {(a, b): product[:, :, a, b] * (1 if a == b else 2) for a in range(4) for b in range(a, 4)}
    starts = []
    for names in ([(0, 0), (0, 1), (0, 2), (0, 3)], [(0, 0), (0, 1), (1, 1)], [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2)]):
        found = np.einsum("nkp,np->nk", np.linalg.pinv(np.stack([column[c] for c in names], axis=2)), rho)
        beta = np.zeros((n, 4))
        first = np.sqrt(np.maximum(np.abs(found[:, 0]), 1e-300))
        beta[:, 0] = first
        for at, (a, b) in enumerate(names):
            if a == 0 and b > 0:
                beta[:, b] = found[:, at] * np.sign(found[:, 0]) / first
        for _ in range(8):  # distances between control points hold
            off = np.einsum("na,nb,npab->np", beta, beta, product) - rho
            slope = 2 * np.einsum("nb,npab->npa", beta, product)
            beta = beta - np.einsum("nap,np->na", np.linalg.pinv(slope), off)
        points = np.einsum("npk,nke->npe", alpha, np.einsum("na,nake->nke", beta, kernel))
        depth = (points[..., 2] * on).sum(axis=1)
        starts.append(_fitted(body, points * np.where(depth < 0, -1.0, 1.0)[:, None, None], on))
    return starts


def _flat_starts(body: np.ndarray, seen: np.ndarray, on: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Poses as if all points were equally deep, and their mirrors in depth."""
    w = on[..., None] / on.sum(axis=1)[:, None, None]
    a, b = (body * w).sum(axis=1), (seen * w).sum(axis=1)
    away, off = (body - a[:, None]) * on[..., None], (seen - b[:, None]) * on[..., None]
    m = np.einsum("npk,npi->nki", off, away) @ np.linalg.pinv(np.einsum("npi,npj->nij", away, away), rcond=1e-9, hermitian=True)
    scale = np.maximum(np.linalg.norm(m, axis=2).max(axis=1), 1e-9)
    two = m / scale[:, None, None]
    starts = []
    for sign in (1.0, -1.0):
        # what the rows lack of unit length lies in depth
        lack = np.sqrt(np.maximum(1 - (two**2).sum(axis=2), 0.0))
        side = np.where((two[:, 0] * two[:, 1]).sum(axis=1) > 0, -1.0, 1.0)
        normal = np.linalg.eigh(np.einsum("npi,npj->nij", away, away))[1][:, :, 0]
        rows = two + sign * np.stack([lack[:, 0, None] * normal, (side * lack[:, 1])[:, None] * normal], axis=1)
        r = _nearest_rotation(np.concatenate([rows, np.cross(rows[:, 0], rows[:, 1])[:, None]], axis=1))
        depth = 1 / scale
        starts.append((r, np.c_[b * depth[:, None], depth] - np.einsum("nij,nj->ni", r, a)))
    return starts


def _refined(body: np.ndarray, seen: np.ndarray, on: np.ndarray, focal: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, t, cost): damped Gauss-Newton on the pixels' squares from a start."""

    def residual(r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.einsum("nij,npj->npi", r, body) + t[:, None]
        z = np.maximum(p[..., 2:], 1e-6)
        return (p[..., :2] / z - seen) * focal[:, None] * on[..., None], p

    n = len(body)
    off, p = residual(r, t)
    cost, damping = (off**2).sum(axis=(1, 2)), np.full(n, 1e-3)
    for _ in range(ROUNDS):
        z = np.maximum(p[..., 2], 1e-6)
        x, y, zero = p[..., 0] / z, p[..., 1] / z, np.zeros_like(z)
        by_point = np.stack([np.stack([1 / z, zero, -x / z], axis=-1), np.stack([zero, 1 / z, -y / z], axis=-1)], axis=-2)
        q = p - t[:, None]
        spin = np.stack([zero, q[..., 2], -q[..., 1], -q[..., 2], zero, q[..., 0], q[..., 1], -q[..., 0], zero], axis=-1).reshape(*q.shape[:2], 3, 3)
        slope = np.concatenate([by_point @ spin, by_point], axis=-1) * focal[:, None, :, None] * on[..., None, None]
        slope = slope.reshape(n, -1, 6)
        a = slope.transpose(0, 2, 1) @ slope
        g = np.einsum("nki,nk->ni", slope, off.reshape(n, -1))
        k = np.arange(6)
        a[:, k, k] += damping[:, None] * np.maximum(a[:, k, k], 1e-12) + 1e-300
        move = -np.linalg.solve(a, g[..., None])[..., 0]
        r2, t2 = _turned(move[:, :3]) @ r, t + move[:, 3:]
        off2, p2 = residual(r2, t2)
        cost2 = (off2**2).sum(axis=(1, 2))
        better = cost2 <= cost
        r, t, cost = np.where(better[:, None, None], r2, r), np.where(better[:, None], t2, t), np.where(better, cost2, cost)
        off, p = np.where(better[:, None, None], off2, off), np.where(better[:, None, None], p2, p)
        damping = np.clip(np.where(better, damping * 0.2, damping * 10), 1e-12, 1e9)
        if (np.abs(move).max(axis=1) < 1e-13).all():
            break
    return _nearest_rotation(r), t, cost


def solve(body: np.ndarray, pixels: np.ndarray, on: np.ndarray, cameras: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotations, shifts, mean pixel errors) of bodies (n, p, 3) with pixels (n, p, 2), where on
    (n, p); cameras (n, 4): fx, fy, cx, cy. Each needs LEAST points that are on."""
    focal = cameras[:, :2]
    seen = np.where(on[..., None], (pixels - cameras[:, None, 2:]) / focal[:, None], 0.0)
    body = np.where(on[..., None], body, 0.0)
    best = None
    for r, t in [*_control_starts(body, seen, on), *_flat_starts(body, seen, on)]:
        good = np.isfinite(r).all(axis=(1, 2)) & np.isfinite(t).all(axis=1)
        r, t = np.where(good[:, None, None], r, np.eye(3)), np.where(good[:, None], t, [0.0, 0.0, 1.0])
        found = _refined(body, seen, on, focal, r, t)
        behind = found[1][:, 2] <= DEPTH
        found = (*found[:2], np.where(behind, found[2] + 1e30, found[2]))
        best = found if best is None else tuple(np.where((found[2] < best[2]).reshape(-1, *[1] * (x.ndim - 1)), y, x) for x, y in zip(best, found, strict=True))
    r, t, _ = best
    p = np.einsum("nij,npj->npi", r, body) + t[:, None]
    off = (p[..., :2] / np.maximum(p[..., 2:], 1e-8) - seen) * focal[:, None]
    error = (np.sqrt((off**2).sum(axis=-1)) * on).sum(axis=1) / np.maximum(on.sum(axis=1), 1)
    return r, t, error


@dataclass(frozen=True)
class Gates:
    """What a pose must pass: confidence of its points, and its mean pixel error."""

    confidence: float = CONFIDENCE
    most_error: float = 20.0


def _points(rows, size: int, most: int) -> np.ndarray:
    out = np.full((most, size), np.nan)
    for i, p in enumerate(rows if rows is not None else []):
        if p is not None and len(p) >= size and all(v is not None for v in p[:size]):
            out[i] = p[:size]
    return out


def pose_from_points(df: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """df (body: array of [x, y, z], pixels: array of [u, v], confidence: array or null, camera:
    [fx, fy, cx, cy]) with rotation (rows), shift, pixel_error and status: estimated, no_camera,
    few_points, behind or far_off; the first three are null but where it is estimated.

    Points count where body and pixel are whole and finite and the confidence is enough (no list:
    1 for all; points beyond the list have none). Columns of these names are replaced.
    """
    names = ["rotation", "shift", "pixel_error", "status"]
    rest = [c for c in df.columns if c not in names]
    kept = df.select(*rest)
    row = T.ArrayType(T.DoubleType())
    schema = T.StructType([*kept.schema.fields, T.StructField("rotation", T.ArrayType(row)), T.StructField("shift", row), T.StructField("pixel_error", T.DoubleType()), T.StructField("status", T.StringType())])

    def found(part: pd.DataFrame) -> pd.DataFrame:
        n = len(part)
        most = max([LEAST, *(min(len(b), len(p)) for b, p in zip(part["body"], part["pixels"], strict=True) if b is not None and p is not None)])
        body, pixels = (np.stack([_points(v[:most] if v is not None else None, k, most) for v in part[c]]) for c, k in (("body", 3), ("pixels", 2)))
        sure = np.ones((n, most))
        for i, c in enumerate(part["confidence"]):
            if c is not None:
                sure[i] = 0.0
                c = np.array([np.nan if v is None else v for v in c[:most]], float)
                sure[i, : len(c)] = np.nan_to_num(c, nan=-1.0)
        cameras = np.array([c if c is not None and len(c) == 4 and all(v is not None for v in c) else [np.nan] * 4 for c in part["camera"]], float).reshape(n, 4)
        there = np.isfinite(cameras).all(axis=1) & (cameras[:, :2] != 0).all(axis=1)
        on = np.isfinite(body).all(axis=2) & np.isfinite(pixels).all(axis=2) & (sure >= gates.confidence)
        enough = on.sum(axis=1) >= LEAST
        go = np.flatnonzero(there & enough)
        status = np.where(there, np.where(enough, "estimated", "few_points"), "no_camera").astype(object)
        values: list[list] = [[None] * n for _ in range(3)]
        if len(go):
            r, t, error = solve(body[go], pixels[go], on[go], cameras[go])
            for i, at in enumerate(go):
                if not t[i, 2] > DEPTH:
                    status[at] = "behind"
                elif not error[i] <= gates.most_error:
                    status[at] = "far_off"
                else:
                    values[0][at], values[1][at], values[2][at] = r[i].tolist(), t[i].tolist(), float(error[i])
        return part.assign(rotation=values[0], shift=values[1], pixel_error=pd.Series(values[2], part.index, dtype=object), status=status)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 1024):
                yield found(frame.iloc[lo : lo + 1024].reset_index(drop=True))

    return kept.mapInPandas(run, schema)


def initial_pose(df: DataFrame, gates: Gates = Gates(most_error=float("inf"))) -> DataFrame:
    """pose_from_points() in the rig, with a way out: df also has rig_rotation and origin (of the
    camera in the rig), seen_body (the same points as a camera-near estimate) and wrist (its wrist
    in the camera). Where no pose is estimated, body is turned onto seen_body and put at the wrist.
    `source` is physical_pnp or virtual_camera."""
    posed = pose_from_points(df, gates)
    schema = T.StructType([*posed.schema.fields, T.StructField("turn", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def turned(a, b) -> list | None:
        if a is None or b is None or len(a) != len(b) or len(a) < 3:
            return None
        p, q = (_points(v, 3, len(v)) for v in (a, b))
        good = np.isfinite(p).all(axis=1) & np.isfinite(q).all(axis=1)
        if good.sum() < 3:
            return None
        p, q = p[good], q[good]
        return _nearest_rotation(((q - q.mean(axis=0)).T @ (p - p.mean(axis=0)))[None])[0].tolist()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(turn=[turned(a, b) if s != "estimated" else None for a, b, s in zip(frame["body"], frame["seen_body"], frame["status"], strict=True)])

    own = F.col("status") == "estimated"
    rotation, shift = F.when(own, F.col("rotation")).otherwise(F.col("turn")), F.when(own, F.col("shift")).otherwise(F.col("wrist"))
    in_rig = posed.mapInPandas(run, schema).withColumn("__r", rotation).withColumn("__t", shift)
    placed = {
        "rotation": product(F.col("rig_rotation"), F.col("__r")), "shift": F.zip_with(V.rotated(F.col("rig_rotation"), F.col("__t")), "origin", lambda a, b: a + b),
        "source": F.when(own, "physical_pnp").otherwise("virtual_camera"),
    }
    return in_rig.withColumns(placed).drop("__r", "__t", "turn")


def product(a: Column, b: Column) -> Column:
    """The product of two matrices (arrays of rows)."""
    return V.let(b, lambda m: F.transform(a, lambda row: F.array(*[sum((V.at(row, k) * V.at(V.at(m, k), j) for k in range(3)), F.lit(0.0)) for j in range(3)])))


def transposed(a: Column) -> Column:
    return V.let(a, lambda m: F.array(*[F.array(*[V.at(V.at(m, i), j) for i in range(3)]) for j in range(3)]))


def _plus(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def camera_deltas(seen: DataFrame, rig: DataFrame, references: dict[str, str], keys: list[str]) -> DataFrame:
    """One row for each hand that a camera and its side's reference camera have posed: the move
    of the rig's frame that would make the camera's pose agree (rotation, shift), and both poses.

    seen: keys, hand, camera_id, rotation, shift; rig: camera_id, rotation, origin; a rig has few
    cameras. references: the reference camera of each side."""
    small = F.broadcast(rig.select("camera_id", F.col("rotation").alias("c_rotation"), F.col("origin").alias("c_shift")))
    known = seen.where("rotation is not null").join(small, "camera_id")
    main = F.create_map(*[F.lit(v) for kv in references.items() for v in kv])[F.col("hand")]
    ref = known.where(F.col("camera_id") == main).select(
        *keys, "hand", F.col("camera_id").alias("reference"), F.col("rotation").alias("ref_rotation"), F.col("shift").alias("ref_shift"),
        product(F.col("c_rotation"), F.col("rotation")).alias("h_rotation"), _plus(V.rotated(F.col("c_rotation"), F.col("shift")), F.col("c_shift")).alias("h_shift"),
    )
    both = known.where(F.col("camera_id") != main).join(ref, [*keys, "hand"])
    # the camera as the hand places it, and from the rig's camera to there
    to = product(F.col("h_rotation"), transposed(F.col("rotation")))
    at = _plus(F.col("h_shift"), V.rotated(to, F.col("shift")), -1)
    turn = product(to, transposed(F.col("c_rotation")))
    move = _plus(at, V.rotated(turn, F.col("c_shift")), -1)
    return both.select(*keys, "hand", "camera_id", "reference", turn.alias("delta_rotation"), move.alias("delta_shift"), "rotation", "shift", "ref_rotation", "ref_shift")


def camera_corrections(deltas: DataFrame, most_degrees: float, most_shift: float, least: int) -> DataFrame:
    """(camera_id, n, inliers, status, rotation, shift): the robust mean of each camera's deltas."""
    given = deltas.select("camera_id", F.col("delta_rotation").alias("rotation"), F.col("delta_shift").alias("shift"))
    found = poses.robust_delta(given, ["camera_id"], most_degrees, most_shift, least)
    good = F.col("rx").isNotNull()
    turn = F.when(good, poses.rotation_matrix(V.vec(*[F.col(f"r{a}") for a in "xyz"])))
    return found.select("camera_id", "n", "inliers", F.when(good, "estimated").otherwise("insufficient_consistent_inliers").alias("status"), turn.alias("rotation"), F.when(good, V.vec(*[F.col(f"t{a}") for a in "xyz"])).alias("shift"))


def held_out(deltas: DataFrame, rig: DataFrame, corrections: DataFrame) -> DataFrame:
    """poses.consistency() of hands that the corrections weren't fitted on: each camera's
    correction moves its place in the rig; cameras without one keep it."""
    fix = corrections.where("status = 'estimated'").select("camera_id", F.col("rotation").alias("d_rotation"), F.col("shift").alias("d_shift"))
    both = rig.select("camera_id", F.col("rotation").alias("raw_rotation"), F.col("origin").alias("raw_shift")).join(fix, "camera_id", "left")
    turned = F.when(F.col("d_rotation").isNull(), F.col("raw_rotation")).otherwise(product(F.col("d_rotation"), F.col("raw_rotation")))
    moved = F.when(F.col("d_rotation").isNull(), F.col("raw_shift")).otherwise(_plus(V.rotated(F.col("d_rotation"), F.col("raw_shift")), F.col("d_shift")))
    table = cut(both.select("camera_id", "raw_rotation", "raw_shift", turned.alias("rotation"), moved.alias("shift")))
    pairs = deltas.select("camera_id", "reference", "rotation", "shift", "ref_rotation", "ref_shift")
    return poses.consistency(pairs, table)



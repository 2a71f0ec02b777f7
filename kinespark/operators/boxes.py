"""Matching and suppression of boxes within a key (group, camera). A key holds the few boxes of
one image, so its work is small; keys are what Spark spreads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions import params, sides
from kinespark.functions import vectors as V
from kinespark.sources.scratch import cut

from . import quantiles

KEYS = ["group_id", "camera_id"]


def best_overlap(left: DataFrame, right: DataFrame, least: float = 0.25) -> DataFrame:
    """left with the number and overlap of the right box of its key that overlaps it most, at
    least `least`; the smaller number on ties; null without one."""
    other = right.select(*KEYS, F.col("n").alias("match"), F.col("box").alias("other"))
    pairs = left.join(other, KEYS).withColumn("iou", V.iou(F.col("box"), F.col("other"))).where(F.col("iou") >= least)
    rank = F.row_number().over(Window.partitionBy(*KEYS, "n").orderBy(F.desc("iou"), "match"))
    best = pairs.withColumn("r", rank).where("r = 1").select(*KEYS, "n", "match", "iou")
    return left.select(*KEYS, "n").join(best, [*KEYS, "n"], "left")


def _iou(a: list[float], b: list[float]) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(0.0, w) * max(0.0, h)
    union = _area(a) + _area(b) - shared
    return shared / union if union > 0 else 0.0


def _area(a: list[float]) -> float:
    return max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1])


def _by_key(df: DataFrame, found: Callable[[list[dict]], list[tuple]], columns: str) -> DataFrame:
    """found() over the rows of each key in order of n, as an array built once per key in
    partition batches."""
    names = [c.split()[0] for c in columns.split(", ")]
    rest = [c for c in df.columns if c not in (*KEYS, "n")]
    packed = df.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("n", *rest))).alias("rows"))

    def run(frames):
        for frame in frames:
            out = []
            for group, camera, rows in zip(frame["group_id"], frame["camera_id"], frame["rows"], strict=True):
                out += [(group, camera, *x) for x in found([dict(r, box=list(r["box"])) for r in rows])]
            yield pd.DataFrame(out, columns=[*KEYS, *names])

    return packed.mapInPandas(run, f"group_id long, camera_id string, {columns}")


def hand_jobs(df: DataFrame, least: float = 0.2, most: int = 2, pad: float = 1.0, width: float = 1200.0, height: float = 900.0, priors: dict[str, str] | None = None, overrides: dict[str, str] | None = None) -> DataFrame:
    """Detections of two origins joined one to one into jobs: (group_id, camera_id, job, first,
    second, box, label, label_source, origin, debug_only).

    df: group_id, camera_id, n, box, score, origin, label, label_source. Each "mediapipe" box in
    order takes the unused "sam3" box that overlaps it most (the first of equals, over 0), if by
    `least`; the job has the box around both, and the sam3 label where there is one. Unused sam3
    boxes follow by score and area while there are fewer than `most` jobs that count: with their
    own label, or the other side of the only side seen, or unknown (for debugging only, if both
    sides were seen). Boxes are squares grown by `pad`. A camera's prior side fills unknown
    labels, an override replaces all."""

    def found(rows: list[dict]) -> list[tuple]:
        left, right = ([r for r in rows if r["origin"] == o] for o in ("mediapipe", "sam3"))
        free, jobs = list(right), []
        for a in left:
            best = max(free, key=lambda b: _iou(a["box"], b["box"]), default=None)
            overlap = _iou(a["box"], best["box"]) if best else 0.0
            if best and overlap > 0 and overlap >= least:
                free.remove(best)
                box = [f(x, y) for f, x, y in zip((min, min, max, max), a["box"], best["box"], strict=True)]
                own = best if best["label"] in ("Left", "Right") else a
                jobs.append((a["n"], best["n"], box, own["label"], own["label_source"], "mediapipe+sam3", False))
            else:
                jobs.append((a["n"], None, a["box"], a["label"], a["label_source"], "mediapipe", False))
        seen = {a["label"] for a in left}
        for b in sorted(free, key=lambda b: (-b["score"], -_area(b["box"]), b["n"])):
            if sum(not j[-1] for j in jobs) >= most:
                break
            if b["label"] in ("Left", "Right"):
                label, source, debug = b["label"], b["label_source"], False
            elif len(seen) == 1:
                label, source, debug = {"Left": "Right", "Right": "Left"}.get(*seen, "unknown"), "sam3_opposite_of_single_mediapipe", False
            elif seen:
                label, source, debug = "unknown", "sam3_extra_when_mediapipe_has_both", True
            else:
                label, source, debug = "unknown", "sam3_only_unknown", False
            jobs.append((None, b["n"], b["box"], label, source, "sam3", debug))
        return [(i, *j) for i, j in enumerate(jobs[: max(most, len(left))])]

    jobs = _by_key(df.select(*KEYS, "n", "box", "score", "origin", "label", "label_source"), found, "job long, first double, second double, box array<double>, label string, label_source string, origin string, debug_only boolean")
    jobs = jobs.withColumn("box", V.expand_box(F.col("box"), pad, width, height))
    prior, override = (params.from_map(F.col("camera_id"), m or {}) for m in (priors, overrides))
    by_prior = prior.isNotNull() & sides.takes_prior(F.col("label"), F.col("label_source"))
    return jobs.withColumns(
        {
            "label": F.when(override.isNotNull(), override).when(by_prior, prior).otherwise(F.col("label")),
            "label_source": F.when(override.isNotNull(), F.concat(F.lit("camera_override:"), "camera_id")).when(by_prior, F.concat(F.lit("camera_prior:"), "camera_id")).otherwise(F.col("label_source")),
        }
    )


def greedy_global(df: DataFrame, least: float = 0.05) -> DataFrame:
    """All pairs of the two origins by overlap, greatest first, each box once."""

    def found(rows: list[dict]) -> list[tuple]:
        left, right = ([r for r in rows if r["origin"] == o] for o in ("mediapipe", "sam3"))
        pairs = sorted(((-_iou(a["box"], b["box"]), a["n"], b["n"]) for a in left for b in right))
        a_used, b_used, out = set(), set(), []
        for d, a, b in pairs:
            if -d >= least and a not in a_used and b not in b_used:
                a_used.add(a)
                b_used.add(b)
                out.append((a, b, -d))
        return out

    return _by_key(df, found, "first long, second long, iou double")


def _assigned_all(gain: np.ndarray) -> np.ndarray:
    """For each row of each matrix of `gain` (matrices, rows, no fewer columns) its column in a
    one-to-one choice of the greatest sum: the Hungarian method by shortest augmenting paths, all
    matrices at once."""
    count, n, m = gain.shape
    u, v, row_of = np.zeros((count, n + 1)), np.zeros((count, m + 1)), np.zeros((count, m + 1), int)  # row, column 0 stand for none
    cost, every = -gain, np.arange(count)
    for i in range(1, n + 1):
        row_of[:, 0] = i
        at = np.zeros(count, int)
        least, before, done = np.full((count, m + 1), np.inf), np.zeros((count, m + 1), int), np.zeros((count, m + 1), bool)
        k = every  # matrices whose path isn't at a free column yet
        while len(k):
            done[k, at[k]] = True
            r = row_of[k, at[k]]
            slack = cost[k, r - 1] - u[k, r][:, None] - v[k, 1:]
            l, d, f = least[k], done[k], before[k]
            better = ~d[:, 1:] & (slack < l[:, 1:])
            l[:, 1:] = np.where(better, slack, l[:, 1:])
            before[k, 1:] = np.where(better, at[k][:, None], f[:, 1:])
            to = 1 + np.argmin(np.where(d[:, 1:], np.inf, l[:, 1:]), axis=1)
            step = l[np.arange(len(k)), to]
            own, column = np.nonzero(d)
            u[k[own], row_of[k[own], column]] += step[own]
            v[k[own], column] -= step[own]
            least[k] = np.where(d, l, l - step[:, None])
            at[k] = to
            k = k[row_of[k, to] != 0]
        k = every
        while len(k):
            back = before[k, at[k]]
            row_of[k, at[k]] = row_of[k, back]
            at[k] = back
            k = k[back != 0]
    out = np.zeros((count, n), int)
    own, column = np.nonzero(row_of[:, 1:])
    out[own, row_of[own, column + 1] - 1] = column
    return out


def _assigned(gain: np.ndarray) -> np.ndarray:
    """_assigned_all() of one matrix."""
    return _assigned_all(gain[None])[0]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_iou() of boxes in the last axes of two arrays that broadcast."""
    side = lambda i, j: np.maximum(0.0, np.minimum(a[..., j], b[..., j]) - np.maximum(a[..., i], b[..., i]))
    area = lambda x: np.maximum(0.0, x[..., 2] - x[..., 0]) * np.maximum(0.0, x[..., 3] - x[..., 1])
    shared = side(0, 2) * side(1, 3)
    union = area(a) + area(b) - shared
    return np.where(union > 0, shared / np.where(union > 0, union, 1.0), 0.0)


def optimal(df: DataFrame) -> DataFrame:
    """(keys, first, second, iou): the one-to-one matching of as many boxes of the two origins as
    the fewer have, with the greatest sum of overlaps; pairs that don't overlap are in it too.
    Equal keys have equal matchings, ties too. Keys with as many boxes are matched together."""
    schema = "group_id long, camera_id string, first long, second long, iou double"
    packed = df.select(*KEYS, "n", "box", "origin").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("n", "box", "origin"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2)
            sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
            n, box, origin = rows.flatten().flatten()
            key, n = np.repeat(np.arange(len(sizes)), sizes), n.to_numpy(zero_copy_only=False)
            box = pc.cast(box.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, 4)
            left, right = (np.flatnonzero(pc.fill_null(pc.equal(origin, o), False).to_numpy(zero_copy_only=False)) for o in ("mediapipe", "sam3"))
            lefts, rights = (np.bincount(key[x], minlength=len(sizes)) for x in (left, right))
            starts = np.cumsum(lefts) - lefts, np.cumsum(rights) - rights
            keys, firsts, seconds, gains = [], [], [], []
            for p, q in np.unique(np.stack([lefts, rights], axis=1)[(lefts > 0) & (rights > 0)], axis=0):
                k = np.flatnonzero((lefts == p) & (rights == q))
                a, b = left[starts[0][k][:, None] + np.arange(p)], right[starts[1][k][:, None] + np.arange(q)]
                if p > q:
                    a, b = b, a
                gain = overlaps(box[a][:, :, None], box[b][:, None])
                to = _assigned_all(gain)
                b = np.take_along_axis(b, to, axis=1)
                gains.append(np.take_along_axis(gain, to[:, :, None], axis=2).ravel())
                keys.append(np.repeat(k, a.shape[1]))
                firsts.append(n[b if p > q else a].ravel())
                seconds.append(n[a if p > q else b].ravel())
            if keys:
                k, first, second, iou = (np.concatenate(x) for x in (keys, firsts, seconds, gains))
                order = np.argsort(k, kind="stable")
                found = [pc.cast(batch.column(i), kind).take(pa.array(k[order])) for i, kind in ((0, pa.int64()), (1, pa.string()))]
                yield pa.RecordBatch.from_arrays([*found, *(pa.array(x[order], kind) for x, kind in ((first, pa.int64()), (second, pa.int64()), (iou, pa.float64())))], names=[*KEYS, "first", "second", "iou"])

    return packed.mapInArrow(run, schema)


def suppress(df: DataFrame, least: float = 0.6) -> DataFrame:
    """(keys, n, label_source, is_right): boxes in their order; one that a kept one contains by
    `least` of the smaller area goes, unless either is a hypothesis. The first kept box that
    contains one of trusted label takes that label where its own isn't. An empty box is in none."""

    def found(rows: list[dict]) -> list[tuple]:
        kept: list[dict] = []
        for r in rows:
            twin = next((k for k in kept if "hypothesis" not in (r["label_source"], k["label_source"]) and _contained(r["box"], k["box"]) >= least), None)
            if twin is None:
                kept.append(dict(r))
            elif r["label_source"] in sides.TRUSTED and twin["label_source"] not in sides.TRUSTED:
                twin["label_source"], twin["is_right"] = r["label_source"], r["is_right"]
        return [(k["n"], k["label_source"], k["is_right"]) for k in kept]

    return _by_key(df.select(*KEYS, "n", "box", "label_source", "is_right"), found, "n long, label_source string, is_right double")


def _contained(a: list[float], b: list[float]) -> float:
    least = min(_area(a), _area(b))
    shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return shared / least if least > 0 else 0.0


QUANTILES = {"median": 0.5, "p10": 0.1}


def replay_metrics(pairs: DataFrame, reference: DataFrame, threshold: float = 0.5, wanted: dict[str, float] = QUANTILES) -> DataFrame:
    """One row of a replay's overlaps (from optimal(), with `is_keyframe`) against the reference's
    boxes: their number, matches, share recalled at `threshold`, mean and the quantiles `wanted`,
    and the same off the keyframes. Quantiles read the pairs more than once, so these are cut
    then."""
    parts = {"": F.lit(True), "nonkey_": ~F.col("is_keyframe")}
    pairs = cut(pairs.select("iou", "is_keyframe")) if wanted else pairs
    own, total = [], []
    for name, part in parts.items():
        own += [F.count_if(part).alias(f"{name}matched"), F.count_if(part & (F.col("iou") >= threshold)).alias(f"__{name}recalled"), F.avg(F.when(part, F.col("iou"))).alias(f"{name}mean")]
        total.append(F.count_if(part).alias(f"{name}reference"))
    out = pairs.agg(*own).withColumn("__one", F.lit(1)).join(reference.agg(*total).withColumn("__one", F.lit(1)), "__one")
    for name, part in parts.items():
        if wanted:
            q = quantiles.exact(pairs.where(part), [], "iou", wanted)
            out = out.join(q.select(F.lit(1).alias("__one"), *[F.col(w).alias(f"{name}{w}") for w in wanted]), "__one", "left")
        out = out.withColumn(f"{name}recall", F.col(f"__{name}recalled") / F.nullif(F.col(f"{name}reference"), F.lit(0))).drop(f"__{name}recalled")
    return out.drop("__one")

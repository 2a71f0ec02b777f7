"""Hands refined frame by frame: the points that rays, bones, the palm and the hand before agree on.

Each frame's points solve a robust least-squares problem. Residuals are the ways from a point to
its rays, lengths of bones and of the palm's edges against their targets, and points from the
wrist against those of the hand before. The solver takes many hands at once: every residual
touches one point or two, so the normal equations of a hand are filled block by block, and all
hands of a batch are solved together.

The hand before makes it a fold over a hand's frames. Sequences go in step: a task sorts frames by
their place in the sequence, solves those of equal place together and keeps one hand a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

JOINTS = 21
#: Edges of the hand and of the palm.
BONES = [(0, 1), (1, 2), (2, 3), (3, 4), (0, 5), (5, 6), (6, 7), (7, 8), (5, 9), (9, 10), (10, 11), (11, 12), (9, 13), (13, 14), (14, 15), (15, 16), (13, 17), (0, 17), (17, 18), (18, 19), (19, 20)]
PALM = [(0, 5), (0, 9), (0, 13), (0, 17), (5, 9), (9, 13), (13, 17), (5, 17)]
MODES = np.array(["missing", "local_rejected_outlier", "primary_temporal_local_fallback", "local_refined_metric"])

KEYS = ["sequence_id", "hand", "group_id"]
INPUT = [*KEYS, "camera_id", "joint", "x", "y", "z", "dx", "dy", "dz"]
_JOINT = "struct<joint:int,mode:string,valid:boolean,metric_valid:boolean,position:array<double>,root_relative:array<double>,palm_local:array<double>,used:string,rejected:string,mean_error:double,max_error:double>"
COLUMNS = f"sequence_id long, hand string, group_id long, cost double, iterations int, metric int, fallback int, outlier int, missing int, joints array<{_JOINT}>"
_NAMES = [c.strip().split()[0] for c in "sequence_id long, hand string, group_id long, cost double, iterations int, metric int, fallback int, outlier int, missing int, joints x".split(",")]


@dataclass(frozen=True)
class Rules:
    """The defaults of the rule, in metres where they are lengths; then the solver's."""

    primary: dict[str, str] = field(default_factory=lambda: {"Left": "C1", "Right": "C2"})
    gate: float = 0.06
    mean_error: float = 0.03
    max_error: float = 0.05
    primary_weight: float = 2.0
    other_weight: float = 1.0
    bone_weight: float = 1.5
    palm_weight: float = 1.0
    temporal_weight: float = 1.2
    seed_share: float = 0.35
    scale: float = 0.025
    iterations: int = 200
    step: float = 1e-10
    batch: int = 256


@dataclass
class Problem:
    """Problems of n hands: start (n, 21, 3), free (n, 21); rays o and d (n, 21, r, 3) with weights
    (n, 21, r), 0 for none; edges with targets and weights (n, e), 0 for none; pull towards the
    wrist plus target (n, 21, 3) with weights (n, 21)."""

    start: np.ndarray
    free: np.ndarray
    o: np.ndarray
    d: np.ndarray
    ray_weight: np.ndarray
    edges: np.ndarray
    target: np.ndarray
    edge_weight: np.ndarray
    pull: np.ndarray
    pull_weight: np.ndarray

    def residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted residuals of rays (n, 21, r, 3), edges (n, e) and pulls (n, 21, 3)."""
        off = x[:, :, None] - self.o
        off = off - self.d * (off * self.d).sum(axis=-1, keepdims=True)
        a, b = x[:, self.edges[:, 0]], x[:, self.edges[:, 1]]
        length = np.sqrt(((a - b) ** 2).sum(axis=-1))
        pulled = x - x[:, :1] - self.pull
        return off * self.ray_weight[..., None], (length - self.target) * self.edge_weight, pulled * self.pull_weight[..., None]

    def cost(self, x: np.ndarray, scale: float) -> np.ndarray:
        """Half the sum of scale^2 log(1 + (r / scale)^2) over all residuals of each hand."""
        return sum(np.log1p((r / scale) ** 2).reshape(len(x), -1).sum(axis=1) for r in self.residuals(x)) * (scale * scale / 2)

    def normal(self, x: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
        """(J'WJ, J'Wr) of each hand, residuals weighted by 1 / (1 + (r / scale)^2)."""
        n = len(x)
        rays, edge, pulled = self.residuals(x)
        w_ray, w_edge, w_pull = (1 / (1 + (r / scale) ** 2) for r in (rays, edge, pulled))
        blocks = np.zeros((n, JOINTS, JOINTS, 3, 3))
        gradient = np.zeros((n, JOINTS, 3))
        at = np.arange(JOINTS)
        # a ray's residual is P (x - o) with the projection P = I - d d'
        p = np.eye(3) - self.d[..., :, None] * self.d[..., None, :]
        wp = w_ray[..., None] * p
        blocks[:, at, at] += np.einsum("njr,njrki,njrkl->njil", self.ray_weight**2, p, wp, optimize=True)
        gradient += np.einsum("njr,njrki,njrk->nji", self.ray_weight, p, w_ray * rays, optimize=True)
        a, b = self.edges.T
        way = x[:, a] - x[:, b]
        way = way / np.maximum(np.sqrt((way**2).sum(axis=-1, keepdims=True)), 1e-12)
        block = (self.edge_weight**2 * w_edge)[..., None, None] * way[..., :, None] * way[..., None, :]
        push = (self.edge_weight * w_edge * edge)[..., None] * way
        for e, (i, j) in enumerate(self.edges):
            blocks[:, i, i] += block[:, e]
            blocks[:, j, j] += block[:, e]
            blocks[:, i, j] -= block[:, e]
            blocks[:, j, i] -= block[:, e]
            gradient[:, i] += push[:, e]
            gradient[:, j] -= push[:, e]
        weight = self.pull_weight[..., None] ** 2 * w_pull
        own = weight[..., None] * np.eye(3)
        push = self.pull_weight[..., None] * w_pull * pulled
        blocks[:, at, at] += own
        blocks[:, 0, 0] += own.sum(axis=1)
        blocks[:, 0, at] -= own
        blocks[:, at, 0] -= own
        gradient += push
        gradient[:, 0] -= push.sum(axis=1)
        # points that aren't free stay
        held = ~self.free
        blocks[held] = 0
        blocks.transpose(0, 2, 1, 3, 4)[held] = 0
        where, which = np.nonzero(held)
        blocks[where, which, which] = np.eye(3)
        gradient[held] = 0
        return blocks.transpose(0, 1, 3, 2, 4).reshape(n, 3 * JOINTS, 3 * JOINTS), gradient.reshape(n, -1)


def solve(problem: Problem, scale: float, iterations: int = 200, step: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, cost, iterations) of each hand by Levenberg-Marquardt on the reweighted residuals.
    A hand is done when an accepted step is shorter than `step`; a step that doesn't lower its cost
    is taken back and its damping raised."""
    x = np.where(problem.free[..., None], problem.start, 0.0)
    n, size = len(x), 3 * JOINTS
    damping = np.full(n, 1e-3)
    cost, used = problem.cost(x, scale), np.zeros(n, np.int32)
    going = problem.free.any(axis=1)
    diagonal = np.arange(size)
    for _ in range(iterations):
        now = np.flatnonzero(going)
        if not len(now):
            break
        part = Problem(*[v if v is problem.edges else v[now] for v in vars(problem).values()])
        matrix, gradient = part.normal(x[now], scale)
        scaled = matrix[:, diagonal, diagonal]
        matrix[:, diagonal, diagonal] += damping[now, None] * np.maximum(scaled, 1e-9)
        move = np.linalg.solve(matrix, -gradient[..., None])[..., 0].reshape(-1, JOINTS, 3)
        tried = x[now] + move
        after = part.cost(tried, scale)
        better = after <= cost[now]
        length = np.sqrt((move**2).sum(axis=(1, 2)))
        used[now] += 1
        x[now[better]], cost[now[better]] = tried[better], after[better]
        damping[now] = np.clip(np.where(better, damping[now] * 0.2, damping[now] * 8), 1e-12, 1e12)
        going[now] = (length > step) & (damping[now] < 1e11)
    return x, cost, used


def _met(o: np.ndarray, d: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The point nearest to the rays that are on, for two or more; the one of least length if they
    leave a choice."""
    p = (np.eye(3) - d[..., :, None] * d[..., None, :]) * on[..., None, None]
    a, b = p.sum(axis=-3), np.einsum("...rij,...rj->...i", p, np.nan_to_num(o))
    found = np.einsum("...ij,...j->...i", np.linalg.pinv(a, rcond=3 * np.finfo(float).eps), b)
    return np.where((on.sum(axis=-1) >= 2)[..., None], found, np.nan)


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return np.where(size > 1e-12, v / np.maximum(size, 1e-12), 0.0)


def _apart(p: np.ndarray, o: np.ndarray, d: np.ndarray) -> np.ndarray:
    off = p[:, :, None] - o
    off = off - d * (off * d).sum(axis=-1, keepdims=True)
    return np.sqrt((off * off).sum(axis=-1))


def palm(x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(axes as columns, which hands have them): from wrist, index and little finger bases."""
    across = _unit(x[:, 5] - x[:, 17])
    along = _unit((x[:, 5] + x[:, 17]) / 2 - x[:, 0])
    out = _unit(np.cross(across, along))
    good = there[:, [0, 5, 17]].all(axis=1) & ((across**2).sum(axis=1) > 0) & ((along**2).sum(axis=1) > 0) & ((out**2).sum(axis=1) > 0)
    return np.stack([across, _unit(np.cross(out, across)), out], axis=-1), good


@dataclass
class Frames:
    """Frames of n hands: seeds (n, 21, 3), nan for none; rays (n, 21, r, 3) with the number of
    their camera in `cameras` (n, 21, r), -1 for none; main (n, 21, r)."""

    seeds: np.ndarray
    o: np.ndarray
    d: np.ndarray
    camera: np.ndarray
    main: np.ndarray
    cameras: list[str]


def problem_of(frames: Frames, before: np.ndarray, rules: Rules) -> tuple[Problem, np.ndarray, np.ndarray]:
    """(problem, which rays are accepted, which hands can be refined). before: the points of each
    hand before (n, 21, 3), nan for none."""
    here = frames.camera >= 0
    seed = frames.seeds
    known = np.isfinite(seed).all(axis=-1)
    reference = np.where(known[..., None], seed, before)
    with np.errstate(invalid="ignore"):
        far = _apart(reference, frames.o, frames.d) > rules.gate
    accepted = here & (frames.main | ~far)
    some = accepted.any(axis=-1)
    start = seed.copy()
    for other in (_met(frames.o, frames.d, accepted), before):
        start = np.where((np.isfinite(start).all(axis=-1) | ~some)[..., None], start, other)
    lost = ~np.isfinite(start[:, 0]).all(axis=-1) & (accepted & frames.main)[:, 0].any(axis=-1)
    start[lost, 0] = before[lost, 0]
    root = before - before[:, :1]
    start = np.where(np.isfinite(start), start, start[:, :1] + root)
    there = np.isfinite(start).all(axis=-1)
    can = (here & frames.main).any(axis=(1, 2)) & there[:, 0]
    free = there & some
    free[:, 0] = there[:, 0]
    free &= can[:, None]
    filled = np.nan_to_num(start)
    has_root = np.isfinite(root).all(axis=-1)
    edges = np.array(BONES + PALM)
    a, b = edges.T
    both = (has_root[:, a] & has_root[:, b])[..., None]
    way = np.where(both, np.nan_to_num(root)[:, a] - np.nan_to_num(root)[:, b], filled[:, a] - filled[:, b])
    target = np.sqrt((way**2).sum(axis=-1))
    weight = np.array([rules.bone_weight] * len(BONES) + [rules.palm_weight] * len(PALM))
    on = (target > 1e-5) & free[:, a] & free[:, b]
    old = has_root.any(axis=1)
    pulled = free & np.where(old[:, None], has_root, there)
    pulled[:, 0] = False  # the wrist lies at itself
    pull = np.where(old[:, None, None], np.nan_to_num(root), filled - filled[:, :1])
    strength = rules.temporal_weight * np.where(old, 1.0, rules.seed_share)
    ray_weight = np.where(frames.main, rules.primary_weight, rules.other_weight) * (accepted & free[..., None])
    return Problem(filled, free, frames.o, frames.d, ray_weight, edges, target, on * weight, pull, pulled * strength[:, None]), accepted, can


def refine(frames: Frames, before: np.ndarray, rules: Rules) -> tuple[list[tuple | None], np.ndarray]:
    """((cost, iterations, counts of modes, joints) of each hand or None, the hands to keep).

    A hand needs a ray of its primary camera and a wrist to start from. A joint is metric if the
    primary camera and another accepted one see it within both limits, a fallback if the primary
    does, else rejected or missing; a hand without a metric or fallback joint is none. What is
    kept is the valid joints, of hands whose wrist is valid; else the hand before stays.
    """
    n = len(before)
    problem, accepted, can = problem_of(frames, before, rules)
    x, cost, used = solve(problem, rules.scale, rules.iterations, rules.step)
    there = problem.free
    axes, framed = palm(x, there)
    apart = _apart(x, frames.o, frames.d)
    seen = accepted.sum(axis=-1)
    mean = np.where(seen > 0, (apart * accepted).sum(axis=-1) / np.maximum(seen, 1), np.nan)
    most = np.where(seen > 0, np.where(accepted, apart, -1.0).max(axis=-1, initial=-1.0), np.nan)
    main, other = (accepted & frames.main).any(axis=-1), (accepted & ~frames.main).any(axis=-1)
    rejected = ((frames.camera >= 0) & ~accepted).any(axis=-1)
    with np.errstate(invalid="ignore"):
        metric = there & main & other & (mean <= rules.mean_error) & (most <= rules.max_error)
    mode = np.where(metric, 3, np.where(there & main, 2, np.where(rejected, 1, 0)))
    valid = mode >= 2
    good = can & valid.any(axis=1)
    kept = before.copy()
    new = good & valid[:, 0]
    kept[new] = np.where(valid[new, :, None], x[new], np.nan)
    out: list[tuple | None] = []
    root = x - x[:, :1]
    local = np.einsum("nji,nkj->nki", axes, root)
    for h in range(n):
        if not good[h]:
            out.append(None)
            continue
        joints = []
        for j in range(JOINTS):
            v, m = bool(valid[h, j]), bool(metric[h, j])
            cams = [",".join(sorted({frames.cameras[c] for c in frames.camera[h, j][rays]})) for rays in (accepted[h, j], (frames.camera[h, j] >= 0) & ~accepted[h, j])]
            places = [p.tolist() if v else None for p in (x[h, j], root[h, j], local[h, j] if framed[h] else root[h, j])]
            errors = [float(e[h, j]) if m else None for e in (mean, most)]
            joints.append((j, str(MODES[mode[h, j]]), v, m, *places, cams[0] if v else "", cams[1], *errors))
        counts = [int((mode[h] == k).sum()) for k in (3, 2, 1, 0)]
        out.append((float(cost[h]), int(used[h]), *counts, joints))
    return out, kept


def _packed(df: DataFrame) -> DataFrame:
    """One row for each frame of a hand, with its rays and seeds in order."""
    ray = F.struct("joint", "camera_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "dx", "dy", "dz")])
    return df.where(F.col("joint").between(0, JOINTS - 1)).groupBy(*KEYS).agg(F.array_sort(F.collect_list(ray)).alias("rows"))


def _frames(hands: list[str], rows: list, rules: Rules) -> Frames:
    joint = [np.array([r["joint"] for r in own], int) for own in rows]
    cameras = sorted({r["camera_id"] for own in rows for r in own if r["camera_id"] is not None})
    number = {c: i for i, c in enumerate(cameras)}
    n = len(rows)
    deep = max((int(np.bincount(j).max()) for j in joint if len(j)), default=1)
    frames = Frames(np.full((n, JOINTS, 3), np.nan), np.zeros((n, JOINTS, deep, 3)), np.zeros((n, JOINTS, deep, 3)), np.full((n, JOINTS, deep), -1), np.zeros((n, JOINTS, deep), bool), cameras)
    for h, own in enumerate(rows):
        slots: dict[tuple, int] = {}
        number_at = [0] * JOINTS
        for r in sorted(own, key=lambda r: (r["joint"], r["camera_id"] or "", *(v if v is not None else -np.inf for v in (r[c] for c in ("x", "y", "z", "dx", "dy", "dz"))))):
            j, place = r["joint"], [r["x"], r["y"], r["z"]]
            if None in place:
                continue
            if r["camera_id"] is None:
                frames.seeds[h, j] = place
            elif None not in (r["dx"], r["dy"], r["dz"]):
                k = slots.setdefault((j, r["camera_id"]), number_at[j])
                number_at[j] += k == number_at[j]
                frames.o[h, j, k], frames.d[h, j, k] = place, [r["dx"], r["dy"], r["dz"]]
                frames.camera[h, j, k] = number[r["camera_id"]]
                frames.main[h, j, k] = r["camera_id"] == rules.primary.get(hands[h])
    frames.d = _unit(frames.d)
    return frames


def _none() -> np.ndarray:
    return np.full((JOINTS, 3), np.nan)


def refined(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """df (INPUT) as refined hands (COLUMNS), one for each frame of a hand that refine() gives.

    A row is a ray of a camera (origin and direction in the rig) or, without a camera, the seed of
    a joint. Frames go by group_id within (sequence_id, hand); a sequence starts without a hand
    before. Rows with a null place or direction, or a joint that a hand hasn't, don't count; of
    several rays of a camera at a joint, or seeds of one, the greatest by its numbers counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: dict[tuple, np.ndarray] = {}

        def solved(part: pd.DataFrame) -> pd.DataFrame:
            names = list(zip(part["sequence_id"], part["hand"], strict=True))
            found, kept = refine(_frames(list(part["hand"]), list(part["rows"]), rules), np.stack([before.get(k, _none()) for k in names]), rules)
            before.update(zip(names, kept, strict=True))
            return pd.DataFrame([(*k, g, *f) for k, g, f in zip(names, part["group_id"], found, strict=True) if f], columns=_NAMES)

        for batch in batches:
            for _, part in batch.groupby("place", sort=True):  # a sequence has one frame of a place
                for lo in range(0, len(part), rules.batch):
                    yield solved(part.iloc[lo : lo + rules.batch])

    place = F.row_number().over(Window.partitionBy("sequence_id", "hand").orderBy("group_id"))
    rows = _packed(df.select(*INPUT)).withColumn("place", place)
    return rows.repartition("sequence_id", "hand").sortWithinPartitions("place", "sequence_id", "hand").mapInPandas(run, COLUMNS)


def refined_stream(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """refined() on a stream that has all rows of a frame in one batch: the hand before is the
    state of (sequence_id, hand)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = np.array([np.nan if v is None else v for v in held.get[0]], float).reshape(JOINTS, 3) if held.exists else _none()
        rows = pd.concat(list(frames)).astype(object)
        rows = rows.where(rows.notna(), None)
        rows = rows[rows["joint"].between(0, JOINTS - 1)]
        out = []
        for group, own in rows.groupby("group_id", sort=True):
            found, kept = refine(_frames([key[1]], [own.to_dict("records")], rules), before[None], rules)
            before = kept[0]
            out += [(*key, group, *f) for f in found if f]
        held.update(([None if np.isnan(v) else float(v) for v in before.ravel()],))
        yield pd.DataFrame(out, columns=_NAMES)

    return df.select(*INPUT).groupBy("sequence_id", "hand").applyInPandasWithState(update, COLUMNS, "points array<double>", "append", GroupStateTimeout.NoTimeout)

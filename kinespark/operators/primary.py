"""Fusion around an anchor view, frame by frame: each view is compared with the fused hand before,
the best view anchors, views that agree with it are aligned and fused by medians, and the result
is blended with the hand before. The hand before makes it a fold over each hand's frames, so the
work runs in frame order within a sequence and hand; sequences are what Spark spreads."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = (
    "sequence_id long, hand string, group_id long, anchor string, role string, mode string, reason string, gate string, score double, used string, rejected string, "
    "metric_valid boolean, alpha double, temporal_error double, joints array<array<double>>"
)
INPUT = ["sequence_id", "hand", "group_id", "camera_id", "pos", "quality", "mask_score", "known", "joints"]


@dataclass(frozen=True)
class Rules:
    """The defaults of the rule, in metres where they are lengths."""

    primary: dict[str, str] = field(default_factory=lambda: {"Left": "C1", "Right": "C2"})
    backup: dict[str, str] = field(default_factory=lambda: {"Left": "C0", "Right": "C3"})
    consistency: float = 0.025
    temporal_weight: float = 0.45
    temporal_cap: float = 0.08
    alphas: dict[str, float] = field(default_factory=lambda: {"primary_fused": 0.75, "primary": 0.45, "backup": 0.40, "backup_fused": 0.40, "quality": 0.42, "quality_fused": 0.42})
    other_alpha: float = 0.30
    primary_bonus: float = 0.08
    backup_bonus: float = 0.04
    consensus_weight: float = 0.35
    consensus_cap: float = 0.06
    margin: float = 0.04
    least_score: float = -1.0
    backup_mask: float = 0.25
    backup_quality: float = 0.45
    backup_jump: float = 0.06
    backup_known: bool = True


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """a turned and shifted onto b by least squares, and the mean distance left."""
    p, q = a.mean(axis=0), b.mean(axis=0)
    u, _, vt = np.linalg.svd((a - p).T @ (b - q))
    turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1]) @ u.T
    moved = (a - p) @ turn.T + q
    return moved, float(np.linalg.norm(moved - b, axis=1).mean())


def _views(rows: list[dict], before: np.ndarray | None, rules: Rules) -> dict[str, dict]:
    """Each camera's candidate of best quality less the jump from the hand before, the first of
    equals."""
    found: dict[str, dict] = {}
    for r in rows:
        jump = aligned(r["joints"], before)[1] if before is not None else None
        penalty = rules.temporal_weight * min(jump, rules.temporal_cap) / max(rules.temporal_cap, 1e-6) if jump is not None else 0.0
        view = r | {"jump": jump, "score": r["quality"] - penalty}
        if r["camera_id"] not in found or view["score"] > found[r["camera_id"]]["score"]:
            found[r["camera_id"]] = view
    return dict(sorted(found.items()))


def _role(camera: str, hand: str, rules: Rules) -> str:
    return "primary" if camera == rules.primary.get(hand) else "backup_primary" if camera == rules.backup.get(hand) else "quality_anchor"


def _anchor(views: dict[str, dict], hand: str, rules: Rules) -> tuple[str, str, dict[str, float]]:
    """(camera, reason, scores by camera): the view of greatest score with its agreement with the others and
    its role's bonus; the primary camera stays while it is within the margin."""
    errors: dict[str, list[float]] = {c: [] for c in views}
    names = list(views)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            error = aligned(views[a]["joints"], views[b]["joints"])[1]
            errors[a].append(error)
            errors[b].append(error)
    bonus = {"primary": rules.primary_bonus, "backup_primary": rules.backup_bonus}
    scores = {}
    for c, v in views.items():
        agree = rules.consensus_weight * max(0.0, 1 - min(float(np.median(errors[c])), rules.consensus_cap) / rules.consensus_cap) if errors[c] else 0.0
        scores[c] = v["score"] + agree + bonus.get(_role(c, hand, rules), 0.0)
    best, main = max(views, key=lambda c: scores[c]), rules.primary.get(hand)
    if best == main:
        reason = "canonical_primary_highest_score"
    elif main in scores and scores[best] <= scores[main] + rules.margin:
        best, reason = main, "canonical_primary_within_margin"
    elif main in scores:
        reason = "non_primary_higher_quality"
    else:
        reason = "backup_primary_higher_quality" if _role(best, hand, rules) == "backup_primary" else "highest_quality_score"
    if scores[best] < rules.least_score:
        reason = f"below_min_anchor_score:{reason}"
    return best, reason, scores


def _gate(view: dict, rules: Rules) -> str:
    """Why a backup view may anchor, or not."""
    mask = view["mask_score"] if view["mask_score"] is not None else 0.0
    if rules.backup_known and not view["known"]:
        return "not_known_hypothesis"
    if mask < rules.backup_mask and view["quality"] < rules.backup_quality:
        return "low_mask_score"
    if view["jump"] is not None and view["jump"] > rules.backup_jump:
        return "temporal_discontinuity"
    return "passed" if mask >= rules.backup_mask else "passed_by_view_quality"


def step(before: np.ndarray | None, hand: str, rows: list[dict], rules: Rules) -> dict:
    """The fused hand of one frame from its candidates (joints from the wrist) and the hand
    before. Joints are metres."""
    views = _views(rows, before, rules)
    camera, reason, scores = _anchor(views, hand, rules)
    role, gate, main = _role(camera, hand, rules), None, rules.primary.get(hand)
    if role == "backup_primary":
        gate = _gate(views[camera], rules)
        if not gate.startswith("passed"):
            if main in views:
                camera, role, reason = main, "primary", f"backup_gate_failed_reverted_to_canonical:{gate}"
            else:
                role, reason = "quality_anchor", f"backup_gate_failed_but_no_canonical:{gate}"
    anchor = views[camera]["joints"]
    stack, used, rejected = [anchor], [camera], []
    for c, v in views.items():
        if c != camera:
            moved, error = aligned(v["joints"], anchor)
            if error <= rules.consistency:
                stack.append(moved)
                used.append(c)
            else:
                rejected.append(c)
    fused = np.median(np.stack(stack), axis=0)
    short = {"primary": "primary", "backup_primary": "backup", "quality_anchor": "quality"}[role]
    mode = f"{short}_fused" if len(stack) > 1 else short
    alpha = error = None
    if before is not None:
        last, error = aligned(before, fused)
        alpha = min(1.0, max(0.0, rules.alphas.get(mode, rules.other_alpha)))
        fused = alpha * fused + (1 - alpha) * last
        fused[0] = 0.0
    return {
        "anchor": camera, "role": role, "mode": mode, "reason": reason, "gate": gate, "score": scores[camera], "used": ",".join(used), "rejected": ",".join(rejected),
        "metric_valid": len(stack) > 1, "alpha": alpha, "temporal_error": error, "joints": fused,
    }


def _row(r: dict) -> dict:
    mask, known = r["mask_score"], r["known"]
    return {
        "camera_id": r["camera_id"], "quality": float(r["quality"]), "mask_score": None if pd.isna(mask) else float(mask), "known": bool(known) if not pd.isna(known) else False,
        "joints": np.stack([np.asarray(p, float) for p in r["joints"]]),
    }


def _out(key: tuple, group: int, found: dict) -> tuple:
    rest = [found[c] for c in ("anchor", "role", "mode", "reason", "gate", "score", "used", "rejected", "metric_valid", "alpha", "temporal_error")]
    return (*key, group, *rest, found["joints"].tolist())


_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def fuse_hands(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """df (INPUT: candidates with joints from the wrist; pos orders those of a camera) fused frame
    by frame; see step(). Frames go by group_id within (sequence_id, hand); a sequence starts
    without a hand before. Streams: a task holds one frame and the hand before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[dict]:
            for frame in frames:
                yield from frame.to_dict("records")

        key, before, out = None, None, []
        for (s, h, g), own in groupby(rows(), key=lambda r: (r["sequence_id"], r["hand"], r["group_id"])):
            if (s, h) != key:
                key, before = (s, h), None
            found = step(before, h, [_row(r) for r in own], rules)
            before = found["joints"]
            out.append(_out(key, g, found))
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=_NAMES)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    rows = df.select(*INPUT).repartition("sequence_id", "hand").sortWithinPartitions("sequence_id", "hand", "group_id", "camera_id", "pos")
    return rows.mapInPandas(run, COLUMNS)


def fuse_hands_stream(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """fuse_hands() on a stream that has each frame's candidates in one batch: the hand before is
    the state of (sequence_id, hand)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        before = np.array(held.get[0]).reshape(-1, 3) if held.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values(["group_id", "camera_id", "pos"]).to_dict("records")
        for g, own in groupby(rows, key=lambda r: r["group_id"]):
            found = step(before, key[1], [_row(r) for r in own], rules)
            before = found["joints"]
            out.append(_out(key, g, found))
        held.update((before.ravel().tolist(),))
        yield pd.DataFrame(out, columns=_NAMES)

    return df.select(*INPUT).groupBy("sequence_id", "hand").applyInPandasWithState(update, COLUMNS, "joints array<double>", "append", GroupStateTimeout.NoTimeout)

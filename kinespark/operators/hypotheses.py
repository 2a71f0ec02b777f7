"""The hands of detections whose side is unknown, chosen together for each frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The palm's points, and the costs of moving them and of a second hand.
PALM = [0, 5, 9, 13, 17]
MOVED, SECOND = 0.35, 0.02
SIDES = ("Left", "Right")

COLUMNS = "group_id long, hypothesis string, hand string, camera_id string, cost double, resolved boolean"


def side_cost(views: list[np.ndarray], before: np.ndarray | None) -> float:
    """What one hand's views cost: their mean distance from their middle, and the way of the
    middle's palm from the hand before. One view lies in its middle; no views cost nothing."""
    if not views:
        return 0.0
    shapes = np.asarray(views)
    middle = shapes.sum(axis=0) / len(shapes)
    apart = np.sqrt(((shapes - middle) ** 2).sum(axis=-1)).mean()
    way = 0.0 if before is None else np.sqrt(((middle - before)[PALM] ** 2).sum(axis=-1)).mean()
    return float(apart + MOVED * way)


def choose(rows: list[dict]) -> list[tuple]:
    """(hypothesis, hand, camera, cost, resolved) for the open rows of one frame.

    Known rows (hypothesis null) hold their hand and camera, the best by quality where several
    do. Each hypothesis takes one of its rows, none where that place is held; of all such
    choices the cheapest wins, ties going to Right for the first hypotheses. Where no choice
    fits, each takes its first row and resolved is false. The cost is the sum over the sides, and
    SECOND where both are there; a side's cost depends only on which open rows it takes, so each
    is worked out once. A camera has two places, so there are no more than 2 ** cameras choices.
    """
    held: dict[tuple, dict] = {}
    options: dict[str, list[dict]] = {}
    history = {r["hand"]: r["history"] for r in rows if r["history"] is not None}
    for r in rows:
        place = (r["hand"], r["camera_id"])
        if r["hypothesis"] is not None:
            options.setdefault(r["hypothesis"], []).append(r)
        elif place not in held or r["quality"] > held[place]["quality"]:
            held[place] = r
    names = sorted(options)
    for own in options.values():
        own.sort(key=lambda r: (r["hand"] != "Right", r["hand"], r["camera_id"]))
    known = {side: [r["joints"] for r in held.values() if r["hand"] == side] for side in SIDES}
    table: dict[tuple, float] = {}

    def cost(picked: tuple[dict, ...]) -> tuple[float, int]:
        total, sides = 0.0, 0
        for side in SIDES:
            own = [r for r in picked if r["hand"] == side]
            key = (side, *map(id, own))
            if key not in table:
                table[key] = side_cost(known[side] + [r["joints"] for r in own], history.get(side))
            total += table[key]
            sides += bool(known[side] or own)
        return total + SECOND * (sides == len(SIDES)), sides

    def choices(of: list[str], places: frozenset) -> Iterator[tuple[dict, ...]]:
        if not of:
            yield ()
        for r in options[of[0]] if of else ():
            place = (r["hand"], r["camera_id"])
            if place not in places:
                yield from ((r, *rest) for rest in choices(of[1:], places | {place}))

    # more open detections than places can't fit
    fitting = choices(names, frozenset(held)) if len(names) <= 2 * len({r["camera_id"] for r in rows}) else ()
    best = min(((cost(c), k, c) for k, c in enumerate(fitting)), default=None)  # the first of equals
    picked = best[2] if best else [options[n][0] for n in names]
    return [(n, r["hand"], r["camera_id"], best[0][0] if best else None, best is not None) for n, r in zip(names, picked, strict=True)]


def resolve(df: DataFrame) -> DataFrame:
    """df: group_id, camera_id, hand, hypothesis (null: known), quality, joints and history
    (joints of that hand before, or null). One row for each hypothesis of each group; a group
    holds a frame's few detections."""
    packed = df.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("camera_id", "hand", "hypothesis", "quality", "joints", "history"))).alias("rows"))

    def points(value) -> np.ndarray | None:
        return None if value is None else np.stack([np.asarray(p, float) for p in value])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for group, rows in zip(frame["group_id"], frame["rows"], strict=True):
                own = [{k: points(v) if k in ("joints", "history") else v for k, v in (r if isinstance(r, dict) else r.asDict()).items()} for r in rows]
                out += [(group, *x) for x in choose(own)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return packed.where(F.exists("rows", lambda r: r.hypothesis.isNotNull())).mapInPandas(run, COLUMNS)

"""Live fusion frame by frame: hands of unknown side are chosen together with the known ones, then
each side's views are fused. What is kept between frames is the last shape of each hand and the
side that each track took; the same step serves a batch, read in frame order, and a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinespark.operators import hypotheses

INPUT = ["sequence_id", "group_id", "camera_id", "hand", "hypothesis", "track_id", "quality", "joints"]
COLUMNS = "sequence_id long, group_id long, hand string, views int, cameras string, tracks string, metric_valid boolean, mean_error double, p95_error double, resolved long, joints array<array<double>>"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def step(shapes: dict[str, np.ndarray], sides: dict[str, str], rows: list[dict]) -> list[dict]:
    """The fused hands of one frame; `shapes` (last points by side) and `sides` (by camera and
    track) are updated. rows: candidates in the palm frame; those with a hypothesis come once for
    either side and one of them, or none, is taken. Of a side's candidates of one camera the best
    by quality counts; the views' mean is the hand."""
    open_ = [r for r in rows if r["hypothesis"] is not None]
    chosen = []
    if open_:
        asked = [r | {"history": shapes.get(r["hand"])} for r in rows]
        for name, hand, camera, _, fits in hypotheses.choose(asked):
            if fits:
                chosen.append(next(r for r in open_ if (r["hypothesis"], r["hand"], r["camera_id"]) == (name, hand, camera)))
    for r in chosen:
        if r["track_id"] is not None:
            sides[f"{r['camera_id']}/{r['track_id']}"] = r["hand"]
    out = []
    for hand in ("Left", "Right"):
        best: dict[str, dict] = {}
        for r in [*(r for r in rows if r["hypothesis"] is None), *chosen]:
            if r["hand"] == hand and (r["camera_id"] not in best or r["quality"] > best[r["camera_id"]]["quality"]):
                best[r["camera_id"]] = r
        if not best:
            continue
        views = [best[c] for c in sorted(best)]
        stack = np.stack([r["joints"] for r in views])
        mean = stack.mean(axis=0)
        rest = np.linalg.norm(stack - mean, axis=2)
        shapes[hand] = mean
        out.append({
            "hand": hand, "views": len(views), "cameras": ",".join(r["camera_id"] for r in views), "tracks": ",".join(str(r["track_id"]) for r in views if r["track_id"] is not None),
            "metric_valid": len(views) > 1, "mean_error": float(rest.mean()), "p95_error": float(np.percentile(rest, 95)), "resolved": len(chosen), "joints": mean.tolist(),
        })
    return out


def _row(r: dict) -> dict:
    clean = {c: None if isinstance(r[c], float) and np.isnan(r[c]) else r[c] for c in ("hypothesis", "track_id")}
    return r | clean | {"joints": np.stack([np.asarray(p, float) for p in r["joints"]])}


def _frames(rows: Iterator[dict]) -> Iterator[tuple]:
    for key, own in groupby(rows, key=lambda r: (r["sequence_id"], r["group_id"])):
        yield *key, [_row(r) for r in own]


def fused(df: DataFrame) -> DataFrame:
    """df (INPUT) fused frame by frame in order of group_id within a sequence, which starts without
    shapes; see step(). A task holds one frame and the state."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence, shapes, sides, out = None, {}, {}, []
        for s, g, rows in _frames(r for frame in frames for r in frame.to_dict("records")):
            if s != sequence:
                sequence, shapes, sides = s, {}, {}
            out += [{"sequence_id": s, "group_id": g} | f for f in step(shapes, sides, rows)]
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=_NAMES)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    order = ["sequence_id", "group_id", "camera_id", "hand", "hypothesis", "quality"]
    return df.select(*INPUT).repartition("sequence_id").sortWithinPartitions(*order).mapInPandas(run, COLUMNS)


def fused_stream(df: DataFrame) -> DataFrame:
    """fused() on a stream that has each frame's candidates in one batch: state by sequence."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        given = json.loads(held.get[0]) if held.exists else {"shapes": {}, "sides": {}}
        shapes, sides = {h: np.array(p) for h, p in given["shapes"].items()}, given["sides"]
        rows = pd.concat(list(frames)).sort_values(["group_id", "camera_id", "hand", "hypothesis", "quality"], na_position="first").to_dict("records")
        out = [{"sequence_id": s, "group_id": g} | f for s, g, own in _frames(iter(rows)) for f in step(shapes, sides, own)]
        held.update((json.dumps({"shapes": {h: p.tolist() for h, p in shapes.items()}, "sides": sides}),))
        yield pd.DataFrame(out, columns=_NAMES)

    return df.select(*INPUT).groupBy("sequence_id").applyInPandasWithState(update, COLUMNS, "state string", "append", GroupStateTimeout.NoTimeout)

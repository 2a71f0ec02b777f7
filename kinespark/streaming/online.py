"""Labels of detections frame by frame, as state of a camera: the same step serves a batch, read
in clock order, and a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIDES = ("Left", "Right")
#: Contrary keyframes in a row that change a track's label.
CONFIRM = 2
INPUT = ["camera_id", "group_id", "job", "track_id", "observed", "score", "keyframe"]
COLUMNS = "camera_id string, group_id long, job long, track_id long, label string, rule string"

#: A track's known label, the contrary one seen last, and how often in a row.
Tracks = dict[str, list]


def step(tracks: Tracks, jobs: list[tuple]) -> list[tuple]:
    """(camera, group, job, track, label, rule) for the jobs of one frame; tracks is updated.

    Of several jobs with one label the strongest keeps it: one whose track has that label, then
    the better score, then the smaller job. A track keeps its label against contrary frames
    until CONFIRM keyframes in a row agree. A job without a label takes its track's; without
    that it comes out twice, as either hand.
    """
    seen = {}
    for _, _, job, track, label, score, _ in jobs:
        seen[job] = label if label in SIDES else None
    for side in SIDES:
        own = [j for j in jobs if seen[j[2]] == side]
        known = lambda j: j[3] is not None and tracks.get(str(j[3]), [None])[0] == side
        for weaker in sorted(own, key=lambda j: (not known(j), -(j[5] if j[5] is not None else -1.0), j[2]))[1:]:
            seen[weaker[2]] = None
    rules: dict[int, tuple] = {}
    for _, _, job, track, _, _, keyframe in jobs:
        label, held = seen[job], tracks.get(str(track)) if track is not None else None
        if label is None:
            continue
        if held and held[0] != label:
            if keyframe:
                held[1:] = [label, held[2] + 1 if held[1] == label else 1]
            if not (keyframe and held[2] >= CONFIRM):
                rules[job] = (held[0], "held")
                continue
        if track is not None:
            tracks[str(track)] = [label, None, 0]
        rules[job] = (label, "observed")
    out = []
    for camera, group, job, track, *_ in jobs:
        held = tracks.get(str(track)) if track is not None else None
        found = [rules[job]] if job in rules else [(held[0], "inherited")] if held else [(side, "hypothesis") for side in SIDES]
        out += [(camera, group, job, track, *f) for f in found]
    return out


def _rows(frame: pd.DataFrame) -> Iterator[tuple]:
    for camera, group, job, track, label, score, keyframe in frame[INPUT].itertuples(index=False):
        yield camera, group, job, None if pd.isna(track) else int(track), label, None if pd.isna(score) else score, bool(keyframe)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])
    return found.astype({"track_id": "Int64"})


def online_labels(jobs: DataFrame) -> DataFrame:
    """jobs (INPUT), one camera after the other, by group and job; a job is unique in a frame."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                yield from _rows(frame)

        camera, tracks, out = None, {}, []
        for (now, _), own in groupby(rows(), key=lambda r: r[:2]):
            if now != camera:
                camera, tracks = now, {}
            out += step(tracks, list(own))
            if len(out) > 10_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    return jobs.select(*INPUT).repartition("camera_id").sortWithinPartitions("camera_id", "group_id", "job").mapInPandas(run, COLUMNS)


def online_labels_stream(jobs: DataFrame) -> DataFrame:
    """online_labels() on a stream that has each frame's jobs in one batch: state by camera."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        tracks = json.loads(held.get[0]) if held.exists else {}
        out = []
        for _, own in groupby(_rows(pd.concat(list(frames)).sort_values(["group_id", "job"])), key=lambda r: r[1]):
            out += step(tracks, list(own))
        held.update((json.dumps(tracks),))
        yield _frame(out)

    return jobs.select(*INPUT).groupBy("camera_id").applyInPandasWithState(update, COLUMNS, "tracks string", "append", GroupStateTimeout.NoTimeout)

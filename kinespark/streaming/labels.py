"""The label of a track by weighted votes, as a keyed state: the same step serves a batch, read
in clock order, and a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Lead of votes that locks a label, contrary votes in a row that unlock it, and
#: the weight that the last of them needs.
LOCK, UNLOCK, STRONG = 3.0, 5, 2.0

START = ("unknown", 0.0, 0.0, 0, 0.0)
COLUMNS = "camera_id string, track_id long, t long, label string, confidence double"


def step(state: tuple[str, float, float, int, float], label: str | None, weight: float) -> tuple[str, float, float, int, float]:
    """(locked, left votes, right votes, contrary streak, confidence) after one vote; a vote
    that is neither Left nor Right changes nothing."""
    locked, left, right, streak, confidence = state
    if label not in ("Left", "Right"):
        return state
    left, right = left + weight * (label == "Left"), right + weight * (label == "Right")
    if locked == "unknown":
        lead = abs(left - right)
        if lead >= LOCK:
            locked = "Left" if left >= right else "Right"
            confidence = min(1.0, 0.5 + 0.5 * lead / max(left + right, LOCK))
    elif label == locked:
        streak, confidence = 0, min(1.0, confidence + 0.04 * weight)
    else:
        streak += 1
        if streak >= UNLOCK and weight >= STRONG:
            locked, streak, confidence = label, 0, 0.7
    return locked, left, right, streak, confidence


def locked_labels(votes: DataFrame) -> DataFrame:
    """votes: camera_id, track_id, t, vote, weight. Each row's label after its vote, in the
    order of t (ties by vote and weight) within its track."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, START
        for frame in frames:
            out = []
            for camera, track, t, vote, weight in frame.itertuples(index=False):
                if (camera, track) != now:
                    now, state = (camera, track), START
                state = step(state, vote, weight)
                out.append((camera, track, t, state[0], state[4]))
            yield pd.DataFrame(out, columns=["camera_id", "track_id", "t", "label", "confidence"])

    rows = votes.select("camera_id", "track_id", "t", "vote", "weight")
    return rows.repartition("camera_id", "track_id").sortWithinPartitions("camera_id", "track_id", "t", "vote", "weight").mapInPandas(run, COLUMNS)


def locked_labels_stream(votes: DataFrame) -> DataFrame:
    """locked_labels() on a stream: state by track; within a batch rows go by t."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else START
        out = []
        for t, vote, weight in pd.concat(list(frames)).sort_values(["t", "vote", "weight"])[["t", "vote", "weight"]].itertuples(index=False):
            state = step(tuple(state), vote, weight)
            out.append((*key, t, state[0], state[4]))
        held.update(tuple(state))
        yield pd.DataFrame(out, columns=["camera_id", "track_id", "t", "label", "confidence"])

    state = "label string, left_votes double, right_votes double, streak long, confidence double"
    return votes.groupBy("camera_id", "track_id").applyInPandasWithState(update, COLUMNS, state, "append", GroupStateTimeout.NoTimeout)

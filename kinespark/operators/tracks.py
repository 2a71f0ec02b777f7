"""Identities of detections over time: linking by overlap, votes that lock a track's label, two
hands that exclude each other. A camera is one ordered fold; recordings and cameras are what
Spark spreads."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions import vectors as V
from kinespark.streaming import labels

from .boxes import _iou
from .select import first_by, ranked

#: Frames over which a track is remembered, and the overlap that continues it.
MEMORY, CONTINUES = 8, 0.20
#: Weights of a vote by a detector's score, and the score from which it is strong.
WEAK, STRONG, STRONG_SCORE = 1.0, 2.0, 0.85


def dense_index(df: DataFrame, keys: list[str], order: list[str], name: str = "video_frame_index") -> DataFrame:
    """df with the rows of each key numbered from 0 in order, an integer first."""
    return ranked(df, keys, order[0], name, order[1:])


def seeds(boxes: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """boxes with `rank` by score and area, greatest first (ties by n), the first `most` of each
    key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), F.desc(V.area(F.col("box"))), "n"))
    ranked = boxes.withColumn("rank", rank)
    return ranked.where(F.col("rank") <= most) if most else ranked


def first_seeds(boxes: DataFrame, frames: DataFrame, search: int, least: float, most: int) -> DataFrame:
    """For each camera the best `most` boxes of score `least` or more of the first frame that has
    any among its first `search` frames. frames: camera_id, group_id, video_frame_index."""
    early = first_by(frames, ["camera_id"], [F.asc("video_frame_index")], max(1, search)).select("camera_id", "group_id", "video_frame_index")
    good = boxes.where(F.coalesce("score", F.lit(0.0)) >= least).join(early, ["camera_id", "group_id"])
    first = good.withColumn("__first", F.min("video_frame_index").over(Window.partitionBy("camera_id"))).where("video_frame_index = __first").drop("__first")
    return seeds(first, ["camera_id", "group_id"], most)


def link(active: dict, box: list[float], frame: int, taken: set) -> object | None:
    """The remembered track that overlaps the box most (the first of equals), if enough."""
    options = [(t, _iou(box, state[0])) for t, state in active.items() if t not in taken and frame - state[1] <= MEMORY]
    best = max(options, key=lambda o: o[1], default=(None, 0.0))
    return best[0] if best[1] > 0 and best[1] >= CONTINUES else None


def linked(boxes: DataFrame, exclusive: bool = True) -> DataFrame:
    """boxes (camera_id, video_frame_index, n, box) with `track`, a number within the camera:
    frame by frame, each box in order of n continues the track whose last box overlaps it most,
    not older than MEMORY frames; `exclusive`: a track has one box a frame."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        camera, active, fresh = None, {}, 1
        now, taken = None, set()
        for frame in frames:
            tracks = []
            for c, f, box in zip(frame["camera_id"], frame["video_frame_index"], frame["box"], strict=True):
                if c != camera:
                    camera, active, fresh, now = c, {}, 1, None
                if f != now:
                    now, taken = f, set()
                    active = {t: s for t, s in active.items() if f - s[1] <= MEMORY}
                t = link(active, list(box), f, taken if exclusive else set())
                if t is None:
                    t, fresh = fresh, fresh + 1
                taken.add(t)
                active[t] = (list(box), f)
                tracks.append(t)
            yield frame.assign(track=tracks)

    rows = boxes.select("camera_id", "video_frame_index", "n", "box").repartition("camera_id").sortWithinPartitions("camera_id", "video_frame_index", "n")
    return rows.mapInPandas(run, "camera_id string, video_frame_index long, n long, box array<double>, track long")


def frame_tracks(frames: DataFrame, tracked: DataFrame, most: int | None = 2) -> DataFrame:
    """Every frame (camera_id, video_frame_index) with up to `most` (None: all) of its tracks as an array, in
    order of their names, each with its largest box; frames without tracks have an empty one."""
    keys = ["camera_id", "video_frame_index"]
    one = first_by(tracked.withColumn("__area", V.area(F.col("box"))), [*keys, "track"], [F.desc("__area"), F.asc("n")])
    name = F.concat("camera_id", F.lit("_p"), F.lpad(F.col("track").cast("string"), 2, "0"))
    named = one.withColumn("name", F.when(F.length(F.col("track").cast("string")) > 2, F.concat("camera_id", F.lit("_p"), F.col("track").cast("string"))).otherwise(name))
    kept = (named if most is None else first_by(named, keys, [F.asc("name")], most)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias("hands"))
    return frames.select(*keys).join(kept, keys, "left").withColumn("hands", F.coalesce("hands", F.array().cast("array<struct<name:string,n:bigint>>")))


def vote_weight(score: Column, strong: float = STRONG_SCORE) -> Column:
    return F.when(score >= strong, STRONG).otherwise(WEAK)


def exclusive_labels(rows: DataFrame) -> DataFrame:
    """rows (camera_id, video_frame_index, n, label, source, confidence, seen) where two hands of a
    frame exclude each other: an unknown one takes the other side of a known one, and of two with
    one label the weaker (confidence, and a hundredth for each time its track was seen; the second
    of equals) changes. Frames with another number of hands stay as they are."""
    frame = Window.partitionBy("camera_id", "video_frame_index")
    mine = F.struct("label", (F.col("confidence") + 0.01 * F.col("seen")).alias("strength"))
    before, after = (f(mine).over(frame.orderBy("n")) for f in (F.lag, F.lead))
    pair = rows.withColumns({"__mine": mine, "__before": before, "__other": F.coalesce(before, after), "__two": F.count("*").over(frame) == 2})
    opposite = F.when(F.col("__other.label") == "Left", "Right").when(F.col("__other.label") == "Right", "Left")
    fills = F.col("__two") & (F.col("label") == "unknown") & opposite.isNotNull()
    weaker = F.when(F.col("__before").isNull(), F.col("__mine.strength") < F.col("__other.strength")).otherwise(F.col("__mine.strength") <= F.col("__other.strength"))
    repairs = F.col("__two") & (F.col("label") == F.col("__other.label")) & opposite.isNotNull() & weaker
    source = F.when(fills, "mutual_exclusion").when(repairs, "mutual_exclusion_duplicate_repair").otherwise(F.col("source"))
    return pair.withColumns({"label": F.when(fills | repairs, opposite).otherwise(F.col("label")), "source": source}).drop("__mine", "__before", "__other", "__two")


STABLE = "camera_id string, video_frame_index long, n long, track string, label string, source string, confidence double, seen long"


def stabilised(df: DataFrame, most: int | None = 2) -> DataFrame:
    """Stable labels of tracked hands. df: camera_id, video_frame_index, n, box, track_id (null:
    linked by overlap), vote and weight (a detector's label and its weight, or null). Of a frame
    the first `most` hands by n count (None: all). A track's votes lock its label, see labels.step(); then the
    hands of a frame exclude each other. Streams in frame order within a camera, whose tracks are
    remembered for MEMORY frames, their labels for good."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for frame in frames:
                yield from frame.itertuples(index=False, name=None)

        camera, active, states, fresh, out = None, {}, {}, 1, []
        for (c, f), own in groupby(rows(), key=lambda r: r[:2]):
            if c != camera:
                camera, active, states, fresh = c, {}, {}, 1
            active = {t: s for t, s in active.items() if f - s[1] <= MEMORY}
            found = []
            for _, _, n, box, track, vote, weight in list(own)[:most]:
                if track is None:
                    track = link(active, list(box), f, set())
                    if track is None:
                        track, fresh = f"{c}_s{fresh:02d}", fresh + 1
                    active[track] = (list(box), f)
                state, source, seen = states.get(track, (labels.START, "unlocked", 0))
                after = labels.step(state, vote, weight)
                if after[0] != state[0]:
                    kind = "mediapipe_strong" if weight >= STRONG else "mediapipe"
                    source = kind if state[0] == "unknown" else f"flipped_by_{kind}"
                states[track] = (after, source, seen + 1)
                found.append({"n": n, "track": track, "label": after[0], "source": source, "confidence": after[4], "seen": seen + 1})
            out += [(c, f, *r.values()) for r in found]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in STABLE.split(", ")])
                out = []
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in STABLE.split(", ")])

    columns = ["camera_id", "video_frame_index", "n", "box", F.col("track_id").cast("string").alias("track_id"), "vote", F.coalesce("weight", F.lit(0.0)).alias("weight")]
    found = df.select(*columns).repartition("camera_id").sortWithinPartitions("camera_id", "video_frame_index", "n").mapInPandas(run, STABLE)
    return exclusive_labels(found)

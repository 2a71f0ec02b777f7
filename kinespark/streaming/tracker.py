"""Keyframe tracks: boxes of a detector on some frames, carried by motion on those between.

On every `stride`-th frame of a camera, if it has detections, these take over the tracks they
overlap (all pairs by overlap, greatest first, each once) or start tracks with fresh numbers, and
tracks without one end. On other frames each box moves with the points in it, its age rises and
its score falls; a box that has too few points or leaves the image ends. A camera that is silent
for longer than `silence` ends all its tracks. Numbers are never given twice.

A stream goes frame by frame (step()); its state is a map of tracks, the counters of the camera,
and a timer for its silence. A batch does the same for the next frame of many cameras at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinespark.operators import motion
from kinespark.operators.boxes import _iou, overlaps

INPUT = ["camera_id", "t", "frame", "detections", "pairs"]
COLUMNS = "camera_id string, frame long, track long, name string, n long, box array<double>, age long, score double, keyframe_score double, is_keyframe boolean, how string"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Rules:
    """The defaults of the rule; then the image, and seconds of silence."""

    stride: int = 5
    least: float = 0.05
    decay: float = 0.98
    most: int | None = 2
    width: int = 1200
    height: int = 900
    silence: float = 2.0


def refreshed(tracks: dict[int, dict], detections: list[dict], fresh: int, rules: Rules) -> tuple[dict[int, dict], int]:
    """(tracks, next number) at a keyframe. Ties in overlap go to the greater number of track, then
    of detection; the first `most` detections become tracks, all of them take part in the match."""
    pairs = sorted(((_iou(t["box"], d["box"]), k, i) for k, t in tracks.items() for i, d in enumerate(detections)), reverse=True)
    used, of = set(), {}
    for overlap, k, i in pairs:
        if overlap >= rules.least and k not in used and i not in of:
            used.add(k)
            of[i] = k
    out = {}
    for i, d in enumerate(detections if rules.most is None else detections[: rules.most]):
        k = of.get(i)
        if k is None:
            k, fresh = fresh, fresh + 1
        score = d["score"] or 1.0
        out[k] = {"n": d["n"], "box": d["box"], "age": 0, "score": score, "keyframe_score": score}
    return out, fresh


def carried(tracks: dict[int, dict], pairs: np.ndarray, rules: Rules) -> tuple[dict[int, dict], dict[int, str]]:
    """(tracks that go on, why the others end) between keyframes."""
    if not tracks:
        return {}, {}
    boxes = np.array([t["box"] for t in tracks.values()])
    moved, why = _carried(boxes, pairs, np.zeros(len(boxes), int), np.full(len(boxes), len(pairs)), rules)
    out = {k: t | {"box": b.tolist(), "age": t["age"] + 1, "score": t["score"] * rules.decay} for (k, t), b, w in zip(tracks.items(), moved, why, strict=True) if w == CARRIED}
    return out, {k: HOW[w] for k, w in zip(tracks, why, strict=True) if w != CARRIED}


def _carried(boxes: np.ndarray, pairs: np.ndarray, start: np.ndarray, size: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(moved boxes, numbers of HOW) of boxes and the pairs of their frames, `size` from `start`."""
    of = np.repeat(np.arange(len(boxes)), size)
    own = pairs[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(of))]
    box = boxes[of]
    within = (own[:, 0] >= box[:, 0]) & (own[:, 0] <= box[:, 2]) & (own[:, 1] >= box[:, 1]) & (own[:, 1] <= box[:, 3])
    count = np.bincount(of[within], minlength=len(boxes))
    some = count >= 2
    moved, how = motion.moved_many(boxes, own[within & some[of]], np.where(some, count, 0), rules.width, rules.height)
    return moved, np.where(~some, NO_POINTS, np.where(how == 2, LEFT_IMAGE, CARRIED))


def _rows(camera: str, frame: int, tracks: dict[int, dict], keyframe: bool, ended: dict[int, tuple[dict, str]], rules: Rules) -> list[tuple]:
    def row(k: int, t: dict, how: str) -> tuple:
        return (camera, frame, k, f"{camera}_s{k:02d}", t["n"], t["box"], t["age"], t["score"], t["keyframe_score"], keyframe, how)

    live = sorted(tracks.items())
    shown = live if rules.most is None else live[: rules.most]
    return [row(k, t, "detected" if keyframe else "carried") for k, t in shown] + [row(k, t, why) for k, (t, why) in sorted(ended.items())]


def step(state: dict, row: dict, rules: Rules) -> list[tuple]:
    """The rows of one frame; `state` (tracks, next, index, last: seconds or None) is updated."""
    ended: dict[int, tuple[dict, str]] = {}
    if state["last"] is not None and row["t"] - state["last"] > rules.silence:
        ended = {k: (t, "silent") for k, t in state["tracks"].items()}
        state["tracks"] = {}
    first = state["last"] is None
    detections = row["detections"] if state["index"] % rules.stride == 0 or first else []
    before = state["tracks"]
    if detections:
        state["tracks"], state["next"] = refreshed(before, detections, state["next"], rules)
        ended |= {k: (t, "replaced") for k, t in before.items() if k not in state["tracks"]}
    elif not first:
        state["tracks"], why = carried(before, row["pairs"], rules)
        ended |= {k: (before[k], w) for k, w in why.items()}
    state["index"] += 1
    state["last"] = row["t"]
    return _rows(row["camera_id"], row["frame"], state["tracks"], bool(detections), ended, rules)


def _start() -> dict:
    return {"tracks": {}, "next": 1, "index": 0, "last": None}


def _frame(r) -> dict:
    """A row as plain values; detections without a whole box don't count, and go by n."""
    found = []
    for d in r.detections if r.detections is not None else []:
        box = d["box"]
        if box is not None and len(box) == 4 and all(v is not None and np.isfinite(v) for v in box):
            score = d["score"]
            found.append({"n": int(d["n"]), "box": [float(v) for v in box], "score": None if score is None or np.isnan(score) else float(score)})
    return {"camera_id": r.camera_id, "frame": int(r.frame), "t": r.t.timestamp(), "detections": sorted(found, key=lambda d: d["n"]), "pairs": motion.pairs_of(r.pairs)}


#: What `how` says, by number: first the two of live tracks.
HOW = ("detected", "carried", "replaced", "no_points", "left_image", "silent")
DETECTED, CARRIED, REPLACED, NO_POINTS, LEFT_IMAGE, SILENT = range(6)
#: Frames, and bytes of them, that a task takes at once.
FRAMES, BYTES = 1 << 15, 1 << 27


class _Tracks:
    """Live tracks of many cameras as columns, in order of camera and number."""

    TYPES = {"camera": int, "number": int, "n": int, "box": float, "age": int, "score": float, "keyframe_score": float}

    def __init__(self, **columns: np.ndarray):
        self.columns = columns or {c: np.empty((0, 4) if c == "box" else 0, t) for c, t in self.TYPES.items()}

    def __getattr__(self, name: str) -> np.ndarray:
        return self.__dict__["columns"][name]

    def at(self, rows: np.ndarray, **new: np.ndarray) -> _Tracks:
        return _Tracks(**{c: v[rows] for c, v in self.columns.items()} | new)

    def __add__(self, other: _Tracks) -> _Tracks:
        both = _Tracks(**{c: np.concatenate([v, other.columns[c]]) for c, v in self.columns.items()})
        return both.at(np.lexsort((both.number, both.camera)))


def _between(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _matched(tracks: _Tracks, box: np.ndarray, first: np.ndarray, count: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of tracks, rows of detections) that refreshed() matches, for many cameras: a pair that
    is first in order for both its sides is taken, until none is left. first, count: where the
    detections of each track's frame stand."""
    t, d = np.repeat(np.arange(len(first)), count), _between(first, count)
    overlap = overlaps(tracks.box[t], box[d])
    enough = overlap >= least
    t, d, overlap = t[enough], d[enough], overlap[enough]
    order = np.lexsort((-d, -tracks.number[t], -overlap))
    t, d = t[order], d[order]
    found = []
    while len(t):
        own = np.zeros(len(t), bool)
        own[np.intersect1d(np.unique(t, return_index=True)[1], np.unique(d, return_index=True)[1])] = True
        found.append((t[own], d[own]))
        left = ~(np.isin(t, t[own]) | np.isin(d, d[own]))
        t, d = t[left], d[left]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (t, d)


def _block(table: pa.Table, before: dict | None, rules: Rules) -> tuple[pa.RecordBatch, dict]:
    """(rows of the tracks of whole or part recordings, state of the last camera), for frames in
    order of camera, t and frame: step() for the next frame of all cameras at once. `before`: the
    state in which the block before left its last camera."""
    table = table.combine_chunks()
    camera, time, frame, detections, pairs = (c.chunk(0) for c in table.columns)
    # a range of rows for each camera
    code = camera.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    length = np.diff(np.r_[first, len(code)])
    t = pc.cast(pc.cast(time, pa.timestamp("us", time.type.tz)), pa.int64()).to_numpy(zero_copy_only=False) / 1e6
    # detections with a whole box, in order of frame and n
    sizes = pc.fill_null(pc.list_value_length(detections), 0).to_numpy(zero_copy_only=False)
    n, box, score = detections.flatten().flatten()
    box, whole = motion.numbers_of(box, 4)
    of = np.repeat(np.arange(len(code)), sizes)[whole]
    n, box, score = pc.cast(n, pa.int64()).filter(pa.array(whole)).to_numpy(zero_copy_only=False), box[whole], pc.cast(score, pa.float64()).to_numpy(zero_copy_only=False)[whole]
    order = np.lexsort((n, of))
    of, n, box, score = of[order], n[order], box[order], np.where(np.isnan(score) | (score == 0), 1.0, score)[order]
    seen = np.bincount(of, minlength=len(code))
    seen_at = np.cumsum(seen) - seen
    pair, paired = motion.pairs_in(pairs)
    pair_at = np.cumsum(paired) - paired

    fresh, index, last, known = np.ones(len(first), int), np.zeros(len(first), int), np.full(len(first), np.nan), np.zeros(len(first), bool)
    live = _Tracks()
    if before is not None and before["camera"] == camera[0].as_py():
        fresh[0], index[0], last[0], known[0] = before["next"], before["index"], before["last"], True
        live = before["tracks"].at(slice(None), camera=np.zeros(len(before["tracks"].number), int))
    out: list[tuple[_Tracks, np.ndarray, np.ndarray, np.ndarray]] = []

    def say(tracks: _Tracks, how: np.ndarray | int, at: np.ndarray, key: np.ndarray) -> None:
        if len(tracks.number):
            out.append((tracks, np.broadcast_to(how, tracks.number.shape), at[tracks.camera], key[tracks.camera]))

    for k in range(length.max()):
        on = length > k
        row = np.where(on, first + k, 0)
        key = on & ((index % rules.stride == 0) | ~known) & (seen[row] > 0)
        silent = on & known & (t[row] - last > rules.silence)
        gone = silent[live.camera]
        if gone.any():
            say(live.at(gone), SILENT, row, key)
            live = live.at(~gone)
        old, rest, still = live.at(key[live.camera]), live.at((on & ~key)[live.camera]), live.at(~on[live.camera])
        if len(rest.number):
            box_, how = _carried(rest.box, pair, pair_at[row[rest.camera]], paired[row[rest.camera]], rules)
            go = how == CARRIED
            say(rest.at(~go), how[~go], row, key)
            rest = rest.at(go, box=box_[go], age=rest.age[go] + 1, score=rest.score[go] * rules.decay)
            say(rest, CARRIED, row, key)
        keyed = np.flatnonzero(key)
        if len(keyed):
            frames = row[keyed]
            d = _between(seen_at[frames], seen[frames])
            owner = np.repeat(keyed, seen[frames])
            number = np.zeros(len(d), int)
            a, b = _matched(old, box, seen_at[row[old.camera]], seen[row[old.camera]], rules.least)
            place = np.searchsorted(d, b)  # rows of detections rise, as cameras and their frames do
            number[place] = old.number[a]
            kept = np.ones(len(d), bool) if rules.most is None else d - np.repeat(seen_at[frames], seen[frames]) < rules.most
            new = kept & (number == 0)
            count = np.bincount(owner[new], minlength=len(first))
            number[new] = _between(fresh[keyed], count[keyed])
            fresh += count
            replaced = np.ones(len(old.number), bool)
            replaced[a[kept[place]]] = False
            say(old.at(replaced), REPLACED, row, key)
            d, owner, number = d[kept], owner[kept], number[kept]
            found = _Tracks(camera=owner, number=number, n=n[d], box=box[d], age=np.zeros(len(d), int), score=score[d], keyframe_score=score[d])
            say(found, DETECTED, row, key)
            rest = rest + found
        live = still + rest
        index[on] += 1
        last[on] = t[row[on]]
        known |= on
    end = len(first) - 1
    state = {"camera": camera[len(camera) - 1].as_py(), "next": fresh[end], "index": index[end], "last": last[end], "tracks": live.at(live.camera == end)}
    return _written(out, camera, frame), state


def _written(out: list[tuple], camera: pa.Array, frame: pa.Array) -> pa.RecordBatch:
    """The rows, by frame: live tracks, then those that end, each in order of their numbers."""
    names = [c for c in _NAMES if c != "name"]
    if not out:
        return pa.RecordBatch.from_pylist([], schema=_SCHEMA)
    how, at, key = (np.concatenate([o[i] for o in out]) for i in (1, 2, 3))
    v = {c: np.concatenate([o[0].columns[c] for o in out]) for c in _Tracks.TYPES if c != "camera"}
    order = np.lexsort((v["number"], how > CARRIED, at))
    box = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * 4), pa.array(v["box"][order].ravel()))
    columns = {"camera_id": camera.take(pa.array(at[order])), "frame": frame.take(pa.array(at[order])), "track": pa.array(v["number"][order]), "box": box, "is_keyframe": pa.array(key[order]), "how": pa.array(np.array(HOW, object)[how[order]], pa.string())}
    columns |= {c: pa.array(v[c][order]) for c in ("n", "age", "score", "keyframe_score")}
    return pa.RecordBatch.from_arrays([columns[c].cast(_SCHEMA.field(c).type) for c in names], schema=_SCHEMA)


_KINDS = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in COLUMNS.split(", ")) if n != "name"])


def tracked(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """df, one row for each frame of a camera (camera_id, t timestamp, frame, detections: array of
    (n, box, score), pairs: array of [x, y, u, v] from the frame before), as rows of tracks
    (COLUMNS). `how` is detected, carried, or why the track ends here: replaced, no_points,
    left_image, silent. Frames go by t, then frame, within a camera; a task takes blocks of
    frames and all cameras of a block frame by frame together, and keeps the state of the block's
    last camera. rules.most limits the tracks of a frame (None: all); tracks that a keyframe
    leaves out by the limit aren't started. Null detections and pairs are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = [], None
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= FRAMES or sum(b.nbytes for b in held) >= BYTES:
                found, state = _block(pa.Table.from_batches(held), state, rules)
                held = []
                yield found
        if held:
            yield _block(pa.Table.from_batches(held), state, rules)[0]

    whole = [F.col("camera_id").cast("string"), "t", F.col("frame").cast("long"), F.col("detections").cast("array<struct<n:long,box:array<double>,score:double>>"), F.col("pairs").cast("array<array<double>>")]
    found = df.select(*INPUT).repartition("camera_id").sortWithinPartitions("camera_id", "t", "frame").select(*whole)
    number = F.col("track").cast("string")
    name = F.concat(F.coalesce("camera_id", F.lit("None")), F.lit("_s"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    return found.mapInArrow(run, COLUMNS.replace("name string, ", "")).withColumn("name", name).select(*_NAMES)


class Tracker(StatefulProcessor):
    """tracked() for one camera after another: a map of its tracks, its counters, and a timer."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "track long", "n long, box array<double>, age long, score double, keyframe_score double")
        self.counters = handle.getValueState("counters", "next long, number long, last double, frame long")

    def _read(self) -> tuple[dict, int]:
        state, frame = _start(), 0
        if self.counters.exists():
            state["next"], state["index"], state["last"], frame = self.counters.get()
            names = ("n", "box", "age", "score", "keyframe_score")
            state["tracks"] = {int(k[0]): dict(zip(names, (v[0], list(v[1]), *v[2:]), strict=True)) for k, v in self.tracks.iterator()}
        return state, frame

    def _write(self, state: dict, before: set[int], frame: int) -> None:
        for k in before - state["tracks"].keys():
            self.tracks.removeKey((k,))
        for k, t in state["tracks"].items():
            self.tracks.updateValue((k,), (t["n"], t["box"], t["age"], t["score"], t["keyframe_score"]))
        self.counters.update((state["next"], state["index"], state["last"], frame))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, frame = self._read()
        before = set(state["tracks"])
        out = []
        for r in pd.concat(list(rows)).sort_values(["t", "frame"]).itertuples(index=False):
            out += step(state, _frame(r), self.rules)
            frame = int(r.frame)
        self._write(state, before, frame)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state["tracks"]:
            self.handle.registerTimer(int((state["last"] + self.rules.silence) * 1000) + 1)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, frame = self._read()
        ended = {k: (t, "silent") for k, t in state["tracks"].items()}
        state["tracks"] = {}
        self._write(state, set(ended), frame)
        yield pd.DataFrame(_rows(key[0], frame, {}, False, ended, self.rules), columns=_NAMES)

    def close(self) -> None:
        pass


def tracked_stream(df: DataFrame, rules: Rules = Rules(), late: str = "0 seconds") -> DataFrame:
    """tracked() on a stream of frames that come in order of t. A camera's tracks end when the
    watermark (`late` behind the newest t) passes its silence, in rows of its last frame, or
    with its next frame if that is sooner. The session's state store must be RocksDB (PROVIDER
    as spark.sql.streaming.stateStore.providerClass)."""
    watched = df.select(*INPUT).withWatermark("t", late)
    return watched.groupBy("camera_id").transformWithStateInPandas(Tracker(rules), COLUMNS, "append", "eventTime")


def live(found: DataFrame) -> DataFrame:
    """The tracks that stand on a frame, without those that end there."""
    return found.where(F.col("how").isin("detected", "carried"))

"""Point refinement, box motion and keyframe tracks against direct versions, batch and stream."""

import datetime
import itertools
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from kinespark.operators import motion, refine
from kinespark.operators.boxes import _iou
from kinespark.streaming import tracker


def _hand_rows(seed: int, frames: int = 6, sequences: int = 3) -> list[tuple]:
    """Rays of four cameras at moving hands: gaps, an outlying ray, seeds of some joints, frames
    without wrist or primary camera."""
    rng = np.random.default_rng(seed)
    cameras = {f"C{i}": np.array([0.3 * i - 0.4, 0.1 * i, -1.0]) for i in range(4)}
    rows = []
    for s, hand in itertools.product(range(sequences), ("Left", "Right")):
        base = rng.normal(0, 0.05, (21, 3))
        for g in range(frames):
            points = base + g * 0.004 + rng.normal(0, 0.001, (21, 3))
            for (c, o), j in itertools.product(cameras.items(), range(21)):
                if rng.random() < 0.2 or (c == refine.Rules().primary[hand] and (s, g) == (0, 2)) or (j == 0 and (s, g) == (1, 3)):
                    continue
                d = points[j] + rng.normal(0, 0.002, 3) + (0.2 if (c, j) == ("C0", 3) else 0.0) - o
                rows.append((s, hand, g, c, j, *o.tolist(), *(d * 3).tolist()))
            for j in range(0 if s else 1, 21, 4):
                rows.append((s, hand, g, None, j, *(points[j] + rng.normal(0, 0.002, 3)).tolist(), None, None, None))
    return rows


def _refined_directly(rows: list[tuple], rules: refine.Rules) -> dict:
    """One hand after another with dictionaries, a dense Jacobian by differences, and Newton-like
    steps on the same robust cost."""
    frames = {}
    for s, h, g, c, j, *v in rows:
        frames.setdefault((s, h), {}).setdefault(g, []).append((c, j, np.array(v[:3]), v[3:]))
    out = {}
    for (s, h), of in frames.items():
        main, world, root = rules.primary[h], {}, {}
        for g in sorted(of):
            seeds = {j: p for c, j, p, _ in of[g] if c is None}
            rays = [(c, j, p, np.array(d) / np.linalg.norm(d)) for c, j, p, d in sorted(of[g], key=lambda r: (r[1], str(r[0]))) if c is not None]
            if not any(c == main for c, *_ in rays):
                continue
            off = lambda x, o, d: (x - o) - d * ((x - o) @ d)
            good, bad = {}, {}
            for c, j, o, d in rays:
                at = seeds.get(j, world.get(j))
                fine = c == main or at is None or np.linalg.norm(off(at, o, d)) <= rules.gate
                (good if fine else bad).setdefault(j, []).append((c, o, d))
            start = dict(seeds)
            for j, own in good.items():
                if j not in start:
                    if len(own) >= 2:
                        a = sum(np.eye(3) - np.outer(d, d) for _, _, d in own)
                        start[j] = np.linalg.lstsq(a, sum((np.eye(3) - np.outer(d, d)) @ o for _, o, d in own), rcond=None)[0]
                    elif j in world:
                        start[j] = world[j]
            if 0 not in start and any(c == main for c, *_ in good.get(0, [])) and 0 in world:
                start[0] = world[0]
            if 0 not in start:
                continue
            for j, r in root.items():
                start.setdefault(j, start[0] + r)
            free = sorted(j for j in start if j in good or j == 0)
            at = {j: i for i, j in enumerate(free)}
            edges = []
            for w, group in ((rules.bone_weight, refine.BONES), (rules.palm_weight, refine.PALM)):
                for a, b in group:
                    if a in at and b in at:
                        t = np.linalg.norm(root[a] - root[b]) if a in root and b in root else np.linalg.norm(start[a] - start[b])
                        if t > 1e-5:
                            edges.append((at[a], at[b], t, w))
            rel = root or {j: p - start[0] for j, p in start.items()}
            w_t = rules.temporal_weight * (1 if root else rules.seed_share)

            def residual(v):
                x = v.reshape(-1, 3)
                r = [off(x[at[j]], o, d) * (rules.primary_weight if c == main else rules.other_weight) for j in free for c, o, d in good.get(j, [])]
                r += [[(np.linalg.norm(x[a] - x[b]) - t) * w] for a, b, t, w in edges]
                r += [(x[at[j]] - x[at[0]] - rel[j]) * w_t for j in free if j in rel]
                return np.concatenate(r)

            v, lam = np.concatenate([start[j] for j in free]), 1e-3
            cost = lambda v: rules.scale**2 / 2 * np.log1p((residual(v) / rules.scale) ** 2).sum()
            for _ in range(400):
                r = residual(v)
                jac = np.stack([(residual(v + e) - residual(v - e)) / 2e-7 for e in np.eye(len(v)) * 1e-7], axis=1)
                w = 1 / (1 + (r / rules.scale) ** 2)
                a, b = jac.T @ (w[:, None] * jac), jac.T @ (w * r)
                move = np.linalg.solve(a + lam * np.diag(np.maximum(np.diag(a), 1e-9)), -b)
                if cost(v + move) <= cost(v):
                    v, lam = v + move, max(lam * 0.2, 1e-12)
                    if np.linalg.norm(move) < 1e-9:
                        break
                else:
                    lam *= 8
                    if lam > 1e10:
                        break
            x = dict(zip(free, v.reshape(-1, 3), strict=True))
            modes = {}
            for j in range(21):
                own = good.get(j, []) if j in x else []
                errors = [np.linalg.norm(off(x[j], o, d)) for _, o, d in own]
                cams = {c for c, *_ in own}
                if j in x and main in cams and cams - {main} and np.mean(errors) <= rules.mean_error and max(errors) <= rules.max_error:
                    modes[j] = "local_refined_metric"
                elif j in x and main in cams:
                    modes[j] = "primary_temporal_local_fallback"
                else:
                    modes[j] = "local_rejected_outlier" if j in bad else "missing"
            valid = {j: x[j] for j, m in modes.items() if m.startswith(("local_refined", "primary"))}
            if not valid:
                continue
            out[s, h, g] = (modes, valid)
            if 0 in valid:
                world, root = valid, {j: p - valid[0] for j, p in valid.items()}
    return out


HAND_SCHEMA = "sequence_id long, hand string, group_id long, camera_id string, joint int, x double, y double, z double, dx double, dy double, dz double"


def test_refined_points(spark):
    rows = _hand_rows(1, frames=4, sequences=2)
    rules = refine.Rules(batch=4)
    want = _refined_directly(rows, rules)
    got = refine.refined(spark.createDataFrame(rows, HAND_SCHEMA).repartition(5), rules).collect()
    assert {(r.sequence_id, r.hand, r.group_id) for r in got} == set(want) and len(got) == len(want) > 10
    for r in got:
        modes, valid = want[r.sequence_id, r.hand, r.group_id]
        assert {j.joint: j.mode for j in r.joints} == modes
        assert {j.joint for j in r.joints if j.valid} == set(valid)
        assert max(np.abs(np.array(j.position) - valid[j.joint]).max() for j in r.joints if j.valid) < 1e-6
        assert r.metric + r.fallback + r.outlier + r.missing == 21
    assert any(j.mode == "local_rejected_outlier" or j.rejected for r in got for j in r.joints)


def test_refined_stream_equals_batch(spark, tmp_path):
    rows = _hand_rows(3, frames=4, sequences=2)
    df = spark.createDataFrame(rows, HAND_SCHEMA)
    for g in range(4):
        df.where(f"group_id = {g}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = refine.refined_stream(stream).writeStream.format("memory").queryName("refined").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    places = lambda rows: {(r.sequence_id, r.hand, r.group_id, j.joint): j.position for r in rows for j in r.joints}
    a, b = places(refine.refined(df).collect()), places(spark.table("refined").collect())
    assert a.keys() == b.keys() and len(a) > 200
    assert all((a[k] is None) == (b[k] is None) and (a[k] is None or np.allclose(a[k], b[k], atol=1e-9)) for k in a)


def test_refined_on_hard_rows(spark):
    nothing = spark.createDataFrame([], HAND_SCHEMA)
    assert refine.refined(nothing).count() == 0
    rows = [(0, "Left", 0, "C1", 0, None, 0.0, 0.0, 0.0, 0.0, 1.0), (0, "Left", 0, "C1", 99, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0, "Left", 1, "C1", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (0, "Other", 0, "C1", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    assert refine.refined(spark.createDataFrame(rows * 2, HAND_SCHEMA)).count() == 0


def test_partial_affine_recovers():
    rng = np.random.default_rng(5)
    for _ in range(20):
        p = rng.uniform(0, 300, (40, 2))
        a = rng.uniform(0.8, 1.3) * np.exp(1j * rng.uniform(-1, 1))
        m = np.array([[a.real, -a.imag, 12.0], [a.imag, a.real, -7.0]])
        q = p @ m[:, :2].T + m[:, 2]
        q[:16] += rng.uniform(20, 90, (16, 2))  # 40 % outliers
        found, agree = motion.partial_affine(p, q)
        assert np.allclose(found, m, atol=1e-9) and agree.sum() == 24
        again, _ = motion.partial_affine(p, q)
        assert (again == found).all()
    box = np.array([10.0, 10, 60, 60])
    three = p[:3]
    assert motion.partial_affine(three, three) is None
    assert np.allclose(motion.moved(box, three, three + [5, 2], 500, 500)[0], box + [5, 2, 5, 2]) and motion.moved(box, three, three + 5, 500, 500)[1] == "median"
    assert motion.moved(box, p, p * 3, 5000, 5000)[1] == "median"  # grown beyond the scales
    assert motion.moved(box, three[:0], three[:0], 500, 500) == (None, "lost")
    same = np.ones((9, 2))
    assert motion.partial_affine(same, same) is None and motion.moved(box, same, same + 1, 500, 500)[1] == "median"


def _moved_directly(box, own, width, height):
    """One box by complex numbers, one sample after another."""
    if not len(own):
        return None, "lost"
    p, q = own[:, 0] + 1j * own[:, 1], own[:, 2] + 1j * own[:, 3]
    best, tried = None, len(p) >= motion.LEAST
    for i, j in zip(*motion._samples(len(p)), strict=True) if tried else ():
        if abs(p[j] - p[i]) > 1e-9:
            a = (q[j] - q[i]) / (p[j] - p[i])
            off = abs(a * p + q[i] - a * p[i] - q)
            near = off <= 2.000001
            key = (-near.sum(), round(off[near].sum(), 6))
            best = (key, near) if best is None or key < best[0] else best
    fit, near = None, None if best is None else best[1]
    for _ in range(10 if best else 0):
        x = p[near] - p[near].mean()
        if near.sum() < 2 or (abs(x) ** 2).sum() <= 1e-12:
            fit = None
            break
        a = (x.conj() * q[near]).sum() / (abs(x) ** 2).sum()
        fit = a, q[near].mean() - a * p[near].mean()
        now = abs(a * p + fit[1] - q) <= 2.000001
        if (now == near).all() or now.sum() < near.sum():
            break
        near = now
    how = "affine" if fit and 0.75 <= abs(fit[0]) <= 1.35 else "median"
    a, b = fit if how == "affine" else (1, np.median((q - p).real) + 1j * np.median((q - p).imag))
    z = a * np.array([complex(x, y) for x in box[[0, 2]] for y in box[[1, 3]]]) + b
    x1, y1 = min(max(z.real.min(), 0), width - 2), min(max(z.imag.min(), 0), height - 2)
    x2, y2 = min(max(z.real.max(), x1 + 2), width - 1), min(max(z.imag.max(), y1 + 2), height - 1)
    return ([x1, y1, x2, y2], how) if min(x2 - x1, y2 - y1) >= 3.999999 else (None, "lost")


def test_moved_many_equals_one_by_one():
    rng = np.random.default_rng(8)
    boxes, pairs = [], []
    for t in range(1200):
        k = int(rng.integers(0, 24))
        p = rng.uniform(0, 300, (k, 2)) if t % 5 else np.round(rng.uniform(0, 5, (k, 2))) * 60  # some points are equal
        a = rng.uniform(0.6, 1.5) * np.exp(1j * rng.uniform(-1, 1))
        q = p @ np.array([[a.real, a.imag], [-a.imag, a.real]]) + rng.uniform(-20, 20, 2) + rng.normal(0, (0, 0.5, 3)[t % 3], (k, 2))
        q[rng.random(k) < 0.3] += 50
        at = rng.uniform(0, 690, 2)
        boxes.append(np.r_[at, at + rng.uniform(1, 300, 2)])
        pairs.append(np.c_[p, q])
    counts = np.array([len(x) for x in pairs])
    out, how = motion.moved_many(np.array(boxes), np.concatenate(pairs), counts, 700, 700)
    for box, own, got, kind in zip(boxes, pairs, out, motion.HOW[how], strict=True):
        want = _moved_directly(box, own, 700, 700)
        assert kind == want[1] and (np.isnan(got).all() if want[0] is None else np.allclose(got, want[0], atol=1e-6))
    assert set(how) == {0, 1, 2}
    # rows beside a row, and their number, change nothing in it
    for some in (slice(0, 1), slice(7, 300)):
        again = motion.moved_many(np.array(boxes)[some], np.concatenate(pairs[some]), counts[some], 700, 700)
        assert np.allclose(again[0], out[some], atol=1e-9, equal_nan=True) and (again[1] == how[some]).all()


def test_moved_boxes_take_many_rows(spark):
    """Whole batches are moved at once; only the columns asked for come back."""
    rows = spark.range(0, 20_000, 1, 1).selectExpr("id", "array(10D, 10D, 70D, 70D) AS box", "transform(sequence(0, 8), i -> array(10D + i * i, 20D + i * 3, 15D + i * i + if(i % 4 = id % 4, 40, 0), 18D + i * 3)) AS pairs")
    found = motion.moved_boxes(rows, 500, 500, ["id"])
    assert found.columns == ["id", "moved", "how"]
    assert {(r.how, tuple(round(v, 6) for v in r.moved)) for r in found.distinct().collect()} == {("affine", (15.0, 8.0, 75.0, 68.0))}
    own = np.c_[np.arange(9.0) ** 2, np.arange(9.0), np.arange(9.0) ** 2 + 5, np.arange(9.0) - 2]
    start = time.process_time()
    motion.moved_many(np.tile([0.0, 0, 60, 60], (20_000, 1)), np.tile(own, (20_000, 1)), np.full(20_000, 9), 500, 500)
    assert time.process_time() - start < 4  # some 0.2 s; one by one 11 s


def test_moved_boxes_on_hard_rows(spark):
    rows = [(1, [0.0, 0.0, 50.0, 50.0], None), (2, None, [[1.0, 1.0, 2.0, 2.0]]), (3, [0.0, 0.0, 50.0, 50.0], [[1.0, 1.0, 3.0, 4.0], None, [1.0, None, 2.0, 2.0], [float("nan"), 1.0, 1.0, 1.0]]), (3, [0.0, 0.0, 50.0, 50.0], [[1.0, 1.0, 3.0, 4.0]])]
    df = spark.createDataFrame(rows, "id int, box array<double>, pairs array<array<double>>")
    got = sorted((r.id, r.how, r.moved) for r in motion.moved_boxes(df.selectExpr("*", "'x' AS how"), 500, 500).collect())
    assert got == [(1, "lost", None), (2, "lost", None), (3, "median", [2.0, 3.0, 52.0, 53.0]), (3, "median", [2.0, 3.0, 52.0, 53.0])]


FRAMES = "camera_id string, t timestamp, frame long, detections array<struct<n:long,box:array<double>,score:double>>, pairs array<array<double>>"


def _tracker_frames(seed: int, frames: int = 40) -> list[tuple]:
    """Moving boxes of two cameras: some keyframes see nothing, one pause is long."""
    rng = np.random.default_rng(seed)
    rows = []
    for camera in ("A", "B"):
        at, clock = rng.uniform(50, 700, (3, 2)), 0.0
        for f in range(frames):
            clock += 9.0 if f == 23 else 0.5
            move = rng.uniform(-6, 6, (3, 2))
            pairs = [[*(p + [dx, dy]).tolist(), *(p + m + [dx, dy]).tolist()] for p, m in zip(at, move, strict=True) for dx in (5, 20, 35) for dy in (5, 20, 35)]
            if f % 7 == 3:
                pairs = pairs[9:]  # the first box has no points
            at = at + move
            seen = [] if f % 10 == 5 else [(i, [*p.tolist(), *(p + 40).tolist()], 0.9 - 0.1 * i) for i, p in enumerate(at)]
            rows.append((camera, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=clock), f, seen, pairs))
    return rows


def _tracked_directly(rows: list[tuple], rules: tracker.Rules) -> list[tuple]:
    """Live tracks (camera, frame, track, age, score) with lists, one camera after another."""
    out = []
    for camera in sorted({r[0] for r in rows}):
        tracks, fresh, last = [], 1, None
        for k, (_, t, f, seen, pairs) in enumerate(r for r in rows if r[0] == camera):
            if last is not None and (t - last).total_seconds() > rules.silence:
                tracks = []
            if seen and k % rules.stride == 0:
                options = sorted(((_iou(x["box"], d[1]), x["id"], i) for x in tracks for i, d in enumerate(seen)), reverse=True)
                ids = {}
                for overlap, number, i in options:
                    if overlap >= rules.least and number not in ids.values() and i not in ids:
                        ids[i] = number
                fresh_tracks = []
                for i, d in enumerate(seen[: rules.most]):
                    if i not in ids:
                        ids[i], fresh = fresh, fresh + 1
                    fresh_tracks.append({"id": ids[i], "box": d[1], "age": 0, "score": d[2]})
                tracks = fresh_tracks
            elif last is not None:
                after = []
                for x in tracks:
                    b = x["box"]
                    own = np.array([p for p in pairs if b[0] <= p[0] <= b[2] and b[1] <= p[1] <= b[3]]).reshape(-1, 4)
                    box = motion.moved(np.array(b), own[:, :2], own[:, 2:], rules.width, rules.height)[0] if len(own) >= 2 else None
                    if box is not None:
                        after.append({"id": x["id"], "box": box.tolist(), "age": x["age"] + 1, "score": x["score"] * 0.98})
                tracks = after
            last = t
            out += [(camera, f, x["id"], x["age"], round(x["score"], 9)) for x in tracks]
    return sorted(out)


@pytest.mark.parametrize("most", [2, None])
def test_keyframe_tracks(spark, most):
    rows, rules = _tracker_frames(4), tracker.Rules(most=most)
    df = spark.createDataFrame(rows, FRAMES).repartition(7)
    found = tracker.tracked(df, rules)
    got = sorted((r.camera_id, r.frame, r.track, r.age, round(r.score, 9)) for r in tracker.live(found).collect())
    assert got == _tracked_directly(rows, rules) and len(got) > 80
    # a number that has ended never comes back
    every = found.toPandas()
    for (_, track), own in every.groupby(["camera_id", "track"]):
        ends = own[~own["how"].isin(["detected", "carried"])]
        assert len(ends) <= 1 and (ends.empty or own[own["how"].isin(["detected", "carried"])]["frame"].max() < ends["frame"].iloc[0])
    assert {"silent", "no_points"} <= set(every["how"])


def test_tracker_stream_equals_batch(spark, tmp_path):
    rows, rules = _tracker_frames(6, 30), tracker.Rules()
    df = spark.createDataFrame(rows, FRAMES)
    for lo in range(0, 30, 6):
        df.where(f"frame between {lo} and {lo + 5}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tracker.PROVIDER)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = tracker.tracked_stream(stream, rules).writeStream.format("memory").queryName("tracked").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    rows_of = lambda d: sorted((r.camera_id, r.track, r.how, r.frame if r.how != "silent" else -1, r.age, round(r.score, 9)) for r in d.collect())
    assert rows_of(spark.table("tracked")) == rows_of(tracker.tracked(df, rules))


def test_tracker_on_hard_rows(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("A", t, 0, None, None), ("A", t, 1, [(0, None, 0.5), (1, [0.0, 0.0, 9.0, 9.0], None)], []), (None, t, 0, [(0, [0.0, 0.0, 9.0, 9.0], 0.5)], None)]
    got = tracker.tracked(spark.createDataFrame(rows, FRAMES), tracker.Rules(stride=1)).toPandas()
    assert pd.isna(got["camera_id"]).sum() == 1 and len(got) == 2 and got["score"].tolist().count(1.0) == 1
    assert tracker.tracked(spark.createDataFrame([], FRAMES)).count() == 0


@pytest.mark.parametrize("most", [2, None])
def test_tracks_in_blocks_equal_steps(spark, monkeypatch, most):
    """Recordings cut into blocks, cameras of different lengths side by side, against step()."""
    monkeypatch.setattr(tracker, "BYTES", 1 << 40)
    rules = tracker.Rules(most=most)
    rows = [(f"{r[0]}{x}", *r[1:]) for x in range(5) for r in _tracker_frames(20 + x, 20 + 7 * x)]
    df = spark.createDataFrame(rows, FRAMES)
    want, state, camera = [], None, None
    for r in df.orderBy("camera_id", "t", "frame").toPandas().itertuples(index=False):
        camera, state = (camera, state) if r.camera_id == camera else (r.camera_id, tracker._start())
        want += tracker.step(state, tracker._frame(r._replace(detections=[d.asDict() for d in r.detections])), rules)
    table = df.orderBy("camera_id", "t", "frame").toArrow()
    as_text = lambda r: str([round(v, 6) if isinstance(v, float) else [round(x, 4) for x in v] if isinstance(v, list) else v for v in r])
    plain = sorted(as_text([x for i, x in enumerate(r) if i != 3]) for r in want)
    for size in (1000, 31, 7):
        got, state = [], None
        for at in range(0, table.num_rows, size):
            found, state = tracker._block(table.slice(at, size), state, rules)
            got += [as_text(r.values()) for r in found.to_pylist()]
        assert sorted(got) == plain
    assert {r[10] for r in want} >= {"detected", "carried", "no_points", "silent"} and len(want) > 300


def test_tracks_of_many_frames_take_seconds():
    """60 cameras of 100 frames with three boxes of nine points: some 0.4 ms a box one by one."""
    own = [(x, y, x + 3.0, y + 1.0) for i in range(3) for x in (9.0 + 99 * i, 20.0 + 99 * i, 31.0 + 99 * i) for y in (9.0, 20.0, 31.0)]
    boxes = [{"n": i, "box": [5.0 + 99 * i, 5.0, 45.0 + 99 * i, 45.0], "score": 0.5} for i in range(3)]
    rows = [{"camera_id": f"{c:03d}", "t": datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=f / 2), "frame": f, "detections": boxes if f == 0 else [], "pairs": own} for c in range(60) for f in range(100)]
    kinds = pa.schema([("camera_id", pa.string()), ("t", pa.timestamp("us")), ("frame", pa.int64()), ("detections", pa.list_(pa.struct([("n", pa.int64()), ("box", pa.list_(pa.float64())), ("score", pa.float64())]))), ("pairs", pa.list_(pa.list_(pa.float64())))])
    table = pa.Table.from_pylist(rows, schema=kinds)
    start = time.process_time()
    found, _ = tracker._block(table, None, tracker.Rules(most=None))
    assert found.num_rows > 60 * 30 and time.process_time() - start < 3

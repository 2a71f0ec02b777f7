"""Candidate layer, anchored fusion, calibration, tracks, rays, poses and quantiles against direct
versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF
from tests.test_operators import _streamed

from kinespark.functions import params, sides
from kinespark.functions import vectors as V
from kinespark.operators import calibrate, evaluate, fuse, poses, primary, quantiles, rays, temporal, tracks
from kinespark.operators import boxes as B
from kinespark.operators import candidates as C
from kinespark.plans import catalog
from kinespark.sources import cameras, glove, records
from kinespark.streaming import fusion


@pytest.mark.parametrize(("seed", "buffer"), [(0, 0), (1, 0), (2, 100), (3, quantiles.BUFFER)])
def test_quantiles(spark, seed, buffer):
    r = np.random.default_rng(seed)
    groups = {"a": r.normal(size=3000), "b": np.round(r.random(500), 1), "c": np.array([7.0]), "d": np.r_[np.zeros(900), 1e9, -1e9], None: r.exponential(size=50) * 1e-9}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"low": 0.0, "p10": 0.1, "median": 0.5, "p99": 0.99, "high": 1.0}
    got = {x["k"]: x for x in quantiles.exact(df, ["k"], "v", wanted, buffer).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert all(np.isclose(got[k][n], np.quantile(vs, p), rtol=1e-12, atol=0) or got[k][n] == np.quantile(vs, p) for n, p in wanted.items())
    every = np.concatenate(list(groups.values()))
    assert quantiles.exact(df, [], "v", {"m": 0.25}, buffer).first()["m"] == pytest.approx(np.quantile(every, 0.25))


def test_params():
    assert params.cameras(None, ["C0"]) == ["C0"] and params.cameras(" C1, C2", ["C0"]) == ["C1", "C2"]
    assert params.hands("Left,Right") == ["Left", "Right"] and params.joint_indices("0, 20") == [0, 20]
    assert params.floats("1, 0.5") == [1.0, 0.5] and params.floats("") == [1.0]
    assert params.sides_by_camera("C0:Left,C3=Right") == {"C0": "Left", "C3": "Right"} and params.sides_by_camera("none") == {}
    assert params.cameras_by_side("Left:C9", {"Left": "C0", "Right": "C3"}) == {"Left": "C9", "Right": "C3"}
    assert params.dealt(["a", "b", "c"], 2) == [["a", "c"], ["b"]] and params.dealt(["a"], 5) == [["a"]]
    assert params.number_tag(1.5) == "1p500"
    for wrong in (lambda: params.cameras(" ,", ["C0"]), lambda: params.hands("Middle"), lambda: params.joint_indices("21"), lambda: params.floats("", None), lambda: params.sides_by_camera("C0"), lambda: params.cameras_by_side("Left", {})):
        with pytest.raises(ValueError):
            wrong()


def test_sides(spark):
    rows = [("Left", "Right", "x", 1, 0.5, 0.9), (None, "Right", "", 0, 0.5, 0.9), (None, None, "prompt", 1, None, 0.9), (None, None, "tracker", 1, None, 0.9), ("odd", None, "manual", 7, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "locked string, label string, source string, r int, confidence double, score double")
    got = [tuple(x[0]) for x in df.select(sides.best_label(*[F.col(c) for c in df.columns])).collect()]
    assert got == [("Left", "x", 0.5), ("Right", "sam3", 0.5), ("Right", "prompt", 0.9), (None, None, None), (None, None, None)]
    assert [x[0] for x in df.select(sides.is_right(F.col("label"))).collect()] == [1 if x[1] == "Right" else None for x in rows]


def test_positions(spark):
    p = lambda k: [[float(i), float(k), 0.0] for i in range(21)]
    bad = p(9)[:20] + [[float("nan"), 0.0, 0.0]]
    joints = lambda k, drop=None: [(i, x) for i, x in enumerate(p(k)) if i != drop]
    rows = [
        (0, 1, [("Left", p(1), None), ("Left", p(2), None), ("Right", bad, joints(3)), ("other", p(1), None)]),
        (1, 2, [("Left", None, joints(4, 5))]), (2, 2, [("Left", p(5)[:20], joints(6) + [(0, [9.0, 9.0, 9.0])])]), (3, 2, [("Left", None, None)]), (4, 3, []),
    ]
    df = spark.createDataFrame(rows, "pos int, group_id int, hands array<struct<handedness:string,palm_local_joints_m:array<array<double>>,joints:array<struct<index:int,palm_local_m:array<double>>>>>")
    got = {(r["group_id"], r["hand"]): r["joints"] for r in C.hands_by_group(df, "raw-palm-local", True).collect()}
    assert got == {(1, "Left"): p(2), (1, "Right"): p(3), (2, "Left"): [[9.0, 9.0, 9.0], *p(6)[1:]]}
    assert C.hands_by_group(df, "raw-palm-local").count() == 0
    assert C.output_fields("root-relative") == ("glove_calibrated_root_relative_joints_m", "glove_calibrated_root_relative_m")
    assert C.primary_field("smoothed", {"smoothed"}) == "smoothed"
    with pytest.raises(ValueError):
        C.primary_field("causal-smoothed", {"smoothed"})


def test_landmarks_jobs_and_boxes(spark):
    point = lambda i: (float(i), 1.0, 0.0)
    hand = lambda side, score, n, box=None: (0, side, score, box, 0.3, "t", None, [point(i) for i in range(n)], [])
    rows = [("frame", 1, "C0", [hand("Left", 0.9, 22), hand("Left", 0.8, 21, [0.0, 0.0, 5.0, 5.0]), hand("Right", 0.2, 21), hand("Right", 0.9, 20)]), ("frame", 1, "C1", None)]
    df = spark.createDataFrame(rows, records.HANDS).withColumn("pos", F.monotonically_increasing_id())
    got = C.landmarks_2d(df, 0.5).collect()
    assert [(r["hand"], r["camera_id"], r["score"], len(r["points"])) for r in got] == [("Left", "C0", 0.8, 21)]
    assert [(r["at"], r["label"], r["label_source"]) for r in C.boxed_hands(df).collect()] == [(1, "Left", "sam3")]
    jobs = spark.createDataFrame([("jobs", "C0", [(1, False), (2, True), (3, None)]), ("other", "C0", [(4, False)])], "type string, camera_id string, jobs array<struct<n:int,debug_only:boolean>>")
    assert sorted(r["n"] for r in C.jobs(jobs, "jobs").collect()) == [1, 3] and C.jobs(jobs, "jobs", "C1").count() == 0 and C.jobs(jobs, "jobs", "C0", True).count() == 3


def test_scores_and_structs(spark):
    df = spark.createDataFrame([(0.5, 0.04, True), (0.01, None, False), (0.5, 0.2, False)], "score double, error double, anchor boolean")
    got = df.select(C.temporal_score(F.col("score"), F.col("error"), 0.08, 0.45), C.observation_weight(F.col("score"), F.col("error"), F.col("anchor"), 0.05, 0.08, 2.0), V.cauchy_loss(F.col("score"), 2.0)).collect()
    assert [round(r[0], 9) for r in got] == [0.275, 0.01, 0.05] and np.allclose([r[1] for r in got], [0.5 / 1.25 * 2, 0.05, 0.5 / 7.25]) and np.isclose(got[0][2], math.log1p(0.0625))
    one = spark.createDataFrame([([[1.0, 2.0, 3.0], None, [4.0, 5.0, 6.0]], [[0.0, 0.0, 1.0]])], "j array<array<double>>, p array<array<double>>")
    made = one.select(C.joint_structs(F.col("j"), F.col("p"), ["wrist"]).alias("s"))
    assert [tuple(x) for x in made.first()["s"]] == [(0, "wrist", [1.0, 2.0, 3.0], [0.0, 0.0, 1.0]), (2, "joint_2", [4.0, 5.0, 6.0], [4.0, 5.0, 6.0])]
    put = made.crossJoin(one.select("j")).select(C.with_points(F.col("s"), F.slice("j", 1, 1), "palm_local_m").alias("s")).first()["s"]
    assert put[0]["palm_local_m"] == [1.0, 2.0, 3.0] and put[1]["palm_local_m"] == [4.0, 5.0, 6.0]
    out = C.written(spark.createDataFrame([(1, 2)], "p int, palm_local_joints_m int"), "palm-local", "p", True).first()
    assert out["glove_calibrated_palm_local_joints_m"] == 1 == out["palm_local_joints_m"]
    corners = one.select(V.box_corners(F.array(*[F.lit(float(i)) for i in range(4)]), 2.0)).first()[0]
    assert corners == [[0.0, 2.0], [4.0, 2.0], [4.0, 6.0], [0.0, 6.0]]


def kabsch(a, b):
    p, q = a - a.mean(0), b - b.mean(0)
    u, _, vt = np.linalg.svd(p.T @ q)
    turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
    moved = p @ turn + b.mean(0)
    return moved, np.linalg.norm(moved - b, axis=1).mean()


def direct_fusion(frames, hand, rules):
    """The rule of primary.step() written out once more, over all frames of one hand."""
    before, out = None, []
    for group, rows in frames:
        best = {}
        for r in rows:
            jump = None if before is None else kabsch(r["joints"], before)[1]
            score = r["quality"] - (0 if jump is None else rules.temporal_weight * min(jump, rules.temporal_cap) / rules.temporal_cap)
            if r["camera_id"] not in best or score > best[r["camera_id"]][0]:
                best[r["camera_id"]] = (score, jump, r)
        main, spare = rules.primary[hand], rules.backup[hand]
        total = {}
        for c in sorted(best):
            errors = [kabsch(best[min(c, o)][2]["joints"], best[max(c, o)][2]["joints"])[1] for o in best if o != c]
            agree = rules.consensus_weight * max(0, 1 - min(np.median(errors), rules.consensus_cap) / rules.consensus_cap) if errors else 0
            total[c] = best[c][0] + agree + (rules.primary_bonus if c == main else rules.backup_bonus if c == spare else 0)
        pick = max(sorted(total), key=lambda c: total[c])
        if main in total and total[pick] <= total[main] + rules.margin:
            pick = main
        role = "primary" if pick == main else "backup_primary" if pick == spare else "quality_anchor"
        if role == "backup_primary":
            _, jump, r = best[pick]
            mask = r["mask_score"] or 0.0
            bad = not r["known"] or (mask < rules.backup_mask and r["quality"] < rules.backup_quality) or (jump is not None and jump > rules.backup_jump)
            if bad:
                pick, role = (main, "primary") if main in best else (pick, "quality_anchor")
        anchor = best[pick][2]["joints"]
        near = [kabsch(best[c][2]["joints"], anchor) for c in sorted(best) if c != pick]
        good = [m for m, e in near if e <= rules.consistency]
        fused = np.median(np.stack([anchor, *good]), axis=0)
        mode = {"primary": "primary", "backup_primary": "backup", "quality_anchor": "quality"}[role] + ("_fused" if good else "")
        if before is not None:
            alpha = rules.alphas[mode]
            fused = alpha * fused + (1 - alpha) * kabsch(before, fused)[0]
            fused[0] = 0
        before = fused
        out.append((group, pick, role, mode, len(near) - len(good), fused))
    return out


def _fusion_rows(spark):
    h = fuse.root_relative(records.hands(spark, SF)).withColumn("joints", F.transform("joints", lambda p: V.scaled(p, F.lit(0.1))))
    return h.select("sequence_id", "hand", "group_id", "camera_id", "pos", "quality", F.when(F.col("pos") % 3 != 0, F.col("quality")).alias("mask_score"), (F.col("pos") % 5 != 0).alias("known"), "joints")


def test_primary_fusion(spark, tmp_path):
    df = _fusion_rows(spark)
    rules = primary.Rules(consistency=0.0225)
    got = {(r["sequence_id"], r["hand"], r["group_id"]): r for r in primary.fuse_hands(df, rules).collect()}
    rows = sorted((r.asDict() | {"joints": np.array(r["joints"])} for r in df.collect()), key=lambda r: (r["sequence_id"], r["hand"], r["group_id"], r["camera_id"], r["pos"]))
    n = 0
    for (s, h), own in itertools.groupby(rows, key=lambda r: (r["sequence_id"], r["hand"])):
        frames = [(g, list(x)) for g, x in itertools.groupby(own, key=lambda r: r["group_id"])]
        for group, pick, role, mode, out, fused in direct_fusion(frames, h, rules):
            r = got[s, h, group]
            assert (r["anchor"], r["role"], r["mode"], len([x for x in r["rejected"].split(",") if x])) == (pick, role, mode, out)
            assert np.allclose(np.array(r["joints"]), fused, atol=1e-9)
            n += 1
    assert n == len(got) and len({r["mode"] for r in got.values()}) >= 4
    streamed = _streamed(spark, tmp_path, df, "group_id % 64 div 22 = {i}", lambda x: primary.fuse_hands_stream(x, rules), "fused")
    for r in streamed.collect():
        assert np.allclose(np.array(r["joints"]), np.array(got[r["sequence_id"], r["hand"], r["group_id"]]["joints"]))
    assert streamed.count() == len(got)


def _pairs(spark, n=60, seed=0, noise=0.0):
    r = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(r.normal(size=(3, 3)))
    turn[:, 0] *= np.linalg.det(turn)
    rows = []
    for g in range(n):
        for hand in ("Left", "Right"):
            p = r.normal(size=(21, 3))
            p -= p[0]
            t = 1.3 * p @ turn.T + noise * r.normal(size=(21, 3))
            rows.append((g, hand, p.tolist(), t.tolist()))
    return spark.createDataFrame(rows, "group_id long, hand string, joints array<array<double>>, truth array<array<double>>"), turn


def test_calibration(spark, tmp_path):
    pairs, turn = _pairs(spark)
    train, test = calibrate.split_parity(pairs)
    profile = calibrate.fit_profile(train)
    assert np.isclose(profile["Left"]["scale"], 1.3) and np.allclose(profile["Left"]["rotation"], turn) and profile["Left"]["translation"] == [0.0] * 3
    assert all(r["mean"] < 1e-9 for r in calibrate.errors(calibrate.apply_profile(test, profile)).collect())
    calibrate.save(profile, str(tmp_path / "p.json"))
    again = calibrate.load(str(tmp_path / "p.json"))
    assert np.allclose(again["Right"]["rotation"], profile["Right"]["rotation"])
    few = calibrate.fit_profile(train.where("group_id < 4"), bones=False, offsets=False)
    assert few["Left"]["status"] == "identity" and few["Left"]["scale"] == 1.0
    (tmp_path / "bad.json").write_text('{"profile": {"Left": {"rotation": [1]}}}')
    with pytest.raises(ValueError):
        calibrate.load(str(tmp_path / "bad.json"))


def test_calibration_by_numpy(spark):
    """Similarity, bone scales and offsets on noisy pairs, written out."""
    pairs, _ = _pairs(spark, 40, 1, 0.3)
    profile = calibrate.fit_profile(pairs, least_pairs=10, bone_k=10.0, offset_k=5.0, most_offset=0.05)
    own = [r for r in pairs.collect() if r["hand"] == "Left"]
    p, t = (np.stack([np.array(r[c]) for r in own]) for c in ("joints", "truth"))
    j = calibrate.FIT_JOINTS
    a, b = p[:, j].reshape(-1, 3), t[:, j].reshape(-1, 3)
    am, bm = a.mean(0), b.mean(0)
    u, d, vt = np.linalg.svd((b - bm).T @ (a - am) / len(a))
    s = np.array([1, 1, np.sign(np.linalg.det(u @ vt))])
    rot, scale = u @ np.diag(s) @ vt, (d * s).sum() / ((a - am) ** 2).sum(1).mean()
    moved = scale * p @ rot.T
    scales = []
    for x, y in fuse.BONES:
        ratio = np.linalg.norm(t[:, y] - t[:, x], axis=1) / np.linalg.norm(moved[:, y] - moved[:, x], axis=1)
        scales.append(np.clip(1 + len(ratio) / (len(ratio) + 10) * (np.median(ratio) - 1), 0.7, 1.3))
    out = moved.copy()
    for k, (x, y) in enumerate(fuse.BONES):
        out[:, y] = out[:, x] + scales[k] * (moved[:, y] - moved[:, x])
    offset = (t - out).mean(0) * len(t) / (len(t) + 5)
    size = np.linalg.norm(offset, axis=1, keepdims=True)
    offset = np.where(size > 0.05, offset * 0.05 / np.maximum(size, 1e-12), offset)
    offset[1] = 0  # the thumb's base isn't fitted
    assert np.allclose(profile["Left"]["bone_scales"], scales) and np.allclose(profile["Left"]["offsets"], offset, atol=1e-9)
    got = calibrate.apply_profile(pairs.where("hand = 'Left'"), profile, recentre=True).orderBy("group_id").collect()
    want = out + offset
    assert np.allclose(np.stack([np.array(r["joints"]) for r in got]), want - want[:, :1])


@pytest.mark.parametrize("mode", ["all-joints", "all-joints-velocity", "fingertip-summary"])
def test_features(spark, mode):
    h = records.hands(spark, SF)
    got = {(r["pos"]): r["features"] for r in calibrate.features(h, mode, ["sequence_id", "hand", "camera_id"], "group_id").collect()}
    rows = {(r["sequence_id"], r["hand"], r["camera_id"], r["group_id"]): r for r in h.collect()}
    assert len(got) == len(rows)
    for (s, hand, c, g), r in rows.items():
        p = np.array(r["joints"]) - np.array(r["joints"])[0]
        if mode == "all-joints":
            want = p.ravel()
        elif mode == "all-joints-velocity":
            near = [np.array(rows.get((s, hand, c, g + k), r)["joints"]) for k in (-1, 1)]
            want = np.r_[p.ravel(), 0.5 * ((near[1] - near[1][0]) - (near[0] - near[0][0])).ravel()]
        else:
            tips, bases = p[[4, 8, 12, 16, 20]], p[[2, 5, 9, 13, 17]]
            want = np.r_[tips.ravel(), bases.ravel(), np.linalg.norm(tips, axis=1), np.linalg.norm(bases, axis=1)]
        assert np.allclose(got[r["pos"]], want)


def test_residual_model(spark, tmp_path):
    r = np.random.default_rng(4)
    x = r.normal(size=(90, 6)) * [1, 2, 3, 4, 5, 0]
    y = np.tanh(x @ r.normal(size=(6, 63)) * 0.1) * 0.05
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, features array<double>, residual array<double>")
    train, test = rows.where("id < 60"), rows.where("id >= 60")
    parts = calibrate.fit_residual(train, 2.0)
    calibrate.save_residual(*parts, str(tmp_path / "m"))
    parts = calibrate.load_residual(spark, str(tmp_path / "m"))
    got = {q["id"]: q for q in calibrate.residual_correction(test, *parts, k=5, blend=0.4, shrink=0.9, most=0.03, full=0.5, zero=0.9, least_gate=0.05).collect()}
    a, b = x[:60], y[:60]
    dev = a.std(0)
    dev[dev < 1e-8] = 1
    z = (a - a.mean(0)) / dev
    design = np.c_[np.ones(60), z]
    w = np.linalg.solve(design.T @ design + 2.0 * np.diag([0, *[1] * 6]), design.T @ b)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).mean(2))
    np.fill_diagonal(d, np.inf)
    low, high = np.quantile(d.min(1), [0.5, 0.9])
    for i in range(60, 90):
        q = (x[i] - a.mean(0)) / dev
        dist = np.sqrt(((z - q) ** 2).mean(1))
        best = np.argsort(dist)[:5]
        k = np.exp(-0.5 * (dist[best] / max(dist[best][-1], 1e-6)) ** 2)
        want = 0.6 * (np.r_[1, q] @ w) + 0.4 * (k @ b[best] / k.sum())
        gate = np.clip((max(high, low + 1e-8) - dist.min()) / max(high - low, 1e-8), 0.05, 1)
        want = (want * 0.9 * gate).reshape(21, 3)
        size = np.linalg.norm(want, axis=1, keepdims=True)
        want = np.where(size > 0.03, want * 0.03 / np.maximum(size, 1e-12), want)
        assert np.isclose(got[i]["gate"], gate) and np.allclose(np.array(got[i]["correction"]), want, atol=1e-9)


def test_pixel_corrections(spark):
    r = np.random.default_rng(5)
    views = []
    for i in range(40):
        p = r.random((21, 2)) * [1200, 900]
        far = [(p[0] + 500).tolist(), *p[1:].tolist()]
        views.append((i, {"C0": (p.tolist(), (p + [12.0, -8.0]).tolist()), "C1": (p.tolist(), far), "C2": (p[:5].tolist(), p[:5].tolist())}))
    df = spark.createDataFrame(views, "id int, projections map<string,struct<projected:array<array<double>>,seen:array<array<double>>>>")
    pairs = calibrate.pixel_pairs(df, 1200, 900, 100.0)
    want = sum(bool((0 <= s[0] < 1200) and (0 <= s[1] < 900)) for _, m in views for s in m["C0"][1])
    counts = {x["camera_id"]: x["count"] for x in pairs.groupBy("camera_id").count().collect()}
    assert counts["C0"] == want and "C2" not in counts
    got = {x["camera_id"]: x for x in calibrate.pixel_corrections(pairs, "translation", 50, 0.1, delta=5.0, most=80.0).collect()}
    assert got["C0"]["status"] == "estimated_translation" and np.allclose([got["C0"]["bx"], got["C0"]["by"]], [12, -8]) and got["C0"]["after"] < 1e-9
    assert got["C1"]["status"] == "identity_no_reliable_improvement" and got["C1"]["bx"] == 0.0 and got["C1"]["after"] == got["C1"]["before"]
    few = calibrate.pixel_corrections(pairs, "axis_aligned", 10_000).first()
    assert few["status"] == "insufficient_points" and few["ax"] == 1.0
    stats = {x["camera_id"]: x for x in evaluate.residual_stats(pairs, ["camera_id"]).collect()}
    assert np.isclose(stats["C0"]["median"], math.hypot(12, 8)) and stats["C0"]["points"] == want


def test_memory_gate(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", None)], "worker string, peak double")
    assert calibrate.memory_gate(df.where("peak is not null"), 30.0).first()["peak"] == 30.0
    with pytest.raises(Exception, match="no peak"):
        calibrate.memory_gate(df, 30.0).collect()
    with pytest.raises(Exception, match="budget"):
        calibrate.memory_gate(df.where("peak is not null"), 29.0).collect()


def test_glove_is_all_or_nothing(spark):
    names = ["Frame-No", *(glove.column("Left", j, a) for finger in glove.JOINTS.values() for j in finger for a in "xyz")]
    rows = [(0.0, *map(float, range(60))), (1.0, *map(float, range(59)), float("nan")), (2.0, None, *map(float, range(59)))]
    got = glove.hands(spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names))).collect()
    assert [(r["group_id"], r["hand"]) for r in got] == [(1, "Left")]
    assert got[0]["joints"][4] == [12.0, 13.0, 14.0] and got[0]["joints"][5] == [12.0, 13.0, 14.0] and got[0]["local"][1] == [3.0, 3.0, 3.0]


def test_tracks(spark):
    r = np.random.default_rng(7)
    rows = []
    for c in ("C0", "C1"):
        for f in range(60):
            for n in range(int(r.integers(0, 4))):
                at = r.integers(0, 4) * 20 + r.random(2) * 8
                rows.append((c, f * (1 if f < 40 else 3), n, [float(at[0]), float(at[1]), float(at[0] + 20), float(at[1] + 20)]))
    df = spark.createDataFrame(rows, "camera_id string, video_frame_index long, n long, box array<double>")
    for exclusive in (True, False):
        got = {(x["camera_id"], x["video_frame_index"], x["n"]): x["track"] for x in tracks.linked(df, exclusive).collect()}
        for c in ("C0", "C1"):
            active, fresh = {}, 1
            for f, own in itertools.groupby(sorted(x for x in rows if x[0] == c), key=lambda x: x[1]):
                taken = set()
                for _, _, n, box in own:
                    best, name = 0.0, None
                    for t, (b, last) in active.items():
                        if f - last <= 8 and not (exclusive and t in taken) and B._iou(box, b) > best:
                            best, name = B._iou(box, b), t
                    if name is None or best < 0.2:
                        name, fresh = fresh, fresh + 1
                    taken.add(name)
                    active[name] = (box, f)
                    assert got[c, f, n] == name
    frames = spark.createDataFrame([(c, f) for c in ("C0", "C1") for f in range(130)], "camera_id string, video_frame_index long")
    out = tracks.frame_tracks(frames, tracks.linked(df)).collect()
    assert len(out) == 260 and any(not x["hands"] for x in out) and max(len(x["hands"]) for x in out) == 2


def test_stable_tracks(spark):
    box = lambda x: [float(x), 0.0, x + 10.0, 10.0]
    rows = [("C0", f, 1, box(0), None, "Left", 1.0) for f in range(4)] + [("C0", f, 2, box(100), None, None, None) for f in range(4)] + [("C0", 3, 3, box(200), None, "Left", 9.0), ("C0", 20, 1, box(0), None, None, None)]
    rows += [("C1", f, 1, box(0), "given", "Right", 2.0) for f in range(3)]
    df = spark.createDataFrame(rows, "camera_id string, video_frame_index long, n long, box array<double>, track_id string, vote string, weight double")
    got = {(r["camera_id"], r["video_frame_index"], r["n"]): r for r in tracks.stabilised(df).collect()}
    assert ("C0", 3, 3) not in got  # beyond two hands
    assert [got["C0", f, 1]["label"] for f in range(4)] == ["unknown", "unknown", "Left", "Left"] and got["C0", 2, 1]["source"] == "mediapipe"
    assert [got["C0", f, 2]["label"] for f in range(4)] == ["unknown", "unknown", "Right", "Right"] and got["C0", 2, 2]["source"] == "mutual_exclusion"
    assert got["C0", 20, 1]["track"] == "C0_s03" and got["C0", 20, 1]["label"] == "unknown"  # a track forgotten
    assert got["C1", 1, 1]["label"] == "Right" and got["C1", 1, 1]["source"] == "mediapipe_strong" and got["C1", 2, 1]["seen"] == 3
    assert len(tracks.stabilised(df, None).where("camera_id = 'C0' and video_frame_index = 3").collect()) == 3


def test_exclusive_labels(spark):
    rows = [
        (0, 1, "Left", 0.5, 9), (0, 2, "Left", 0.55, 1), (1, 1, "Left", 0.5, 1), (1, 2, "Left", 0.5, 1), (2, 1, "Right", 0.1, 1), (2, 2, "Right", 0.5, 1), (3, 1, "unknown", 0.1, 1), (3, 2, "Right", 0.5, 1),
        (4, 1, "Right", 0.1, 1), (4, 2, "unknown", 0.5, 1), (5, 1, "unknown", 0.1, 1), (5, 2, "unknown", 0.5, 1), (6, 1, "Left", 0.1, 1), (6, 2, "Right", 0.5, 1), (7, 1, "Left", 0.1, 1), *((8, n, "Left", 0.1, 1) for n in range(3)),
    ]
    df = spark.createDataFrame([("C", f, n, label, "own", c, seen) for f, n, label, c, seen in rows], "camera_id string, video_frame_index long, n long, label string, source string, confidence double, seen long")
    got = {}
    for r in tracks.exclusive_labels(df).orderBy("video_frame_index", "n").collect():
        got.setdefault(r.video_frame_index, []).append((r.label, r.source))
    own, fill, fix = "own", "mutual_exclusion", "mutual_exclusion_duplicate_repair"
    assert got == {
        0: [("Left", own), ("Right", fix)], 1: [("Left", own), ("Right", fix)], 2: [("Left", fix), ("Right", own)], 3: [("Left", fill), ("Right", own)], 4: [("Right", own), ("Left", fill)],
        5: [("unknown", own)] * 2, 6: [("Left", own), ("Right", own)], 7: [("Left", own)], 8: [("Left", own)] * 3,
    }


def test_seed_frames(spark):
    boxes = spark.createDataFrame([("C0", 5, 1, [0.0, 0.0, 2.0, 2.0], 0.9), ("C0", 5, 2, [0.0, 0.0, 3.0, 3.0], 0.9), ("C0", 5, 3, [0.0, 0.0, 9.0, 9.0], 0.5), ("C0", 9, 1, [0.0, 0.0, 1.0, 1.0], 1.0), ("C1", 5, 1, [0.0, 0.0, 1.0, 1.0], None)], "camera_id string, group_id long, n long, box array<double>, score double")
    frames = spark.createDataFrame([(c, g, i) for c in ("C0", "C1") for i, g in enumerate((1, 5, 9))], "camera_id string, group_id long, video_frame_index long")
    assert [(r["camera_id"], r["group_id"], r["n"], r["rank"]) for r in tracks.first_seeds(boxes, frames, 3, 0.4, 2).orderBy("rank").collect()] == [("C0", 5, 2, 1), ("C0", 5, 1, 2)]
    assert tracks.first_seeds(boxes, frames, 1, 0.4, 2).count() == 0


def test_ray_states(spark):
    """The query against the rule written out over all points."""
    got = {(r["group_id"], r["hand"], r["joint"]): r for r in catalog.ray_states(spark, SF).collect()}
    turns = {r["camera_id"]: (np.array(r["origin"]), np.array(r["rotation"])) for r in catalog._poses(spark).collect()}
    points, truth = {}, {}
    for r in records.hands(spark, SF).collect():
        for j, p in enumerate(r["joints"]):
            v = np.array([p[0], p[1], abs(p[2]) + 1.0])
            o, m = turns[r["camera_id"]]
            d = m @ (v / np.linalg.norm(v))
            points.setdefault((r["group_id"], r["hand"], j), []).append((r["camera_id"], o, d))
            if r["camera_id"] == "C3":
                truth[r["group_id"], r["hand"], j] = v
    far = lambda p, o, d: np.linalg.norm(np.cross(d, p - o))
    assert set(got) == set(points)
    modes = set()
    kept, start = {}, {}
    for (g, h, j), rays_ in points.items():
        main = {"Left": "C1", "Right": "C2"}[h]
        seed, before = truth.get((g, h, j)) if j % 3 == 0 else None, truth.get((g - 1, h, j))
        ref = seed if seed is not None else before
        good = [x for x in rays_ if x[0] == main or ref is None or far(ref, x[1], x[2]) <= 0.9]
        kept[g, h, j] = good
        point = seed
        if point is None and len(good) >= 2:
            a = sum(np.eye(3) - np.outer(d, d) for _, _, d in good)
            point = np.linalg.lstsq(a, sum((np.eye(3) - np.outer(d, d)) @ o for _, o, d in good), rcond=None)[0]
        if point is None and good:
            point = before
        if point is None and j == 0 and any(x[0] == main for x in rays_):
            point = before
        start[g, h, j] = point
    for (g, h, j), good in kept.items():
        point, wrist, before, root = start[g, h, j], start.get((g, h, 0)), truth.get((g - 1, h, j)), truth.get((g - 1, h, 0))
        if point is None and wrist is not None and before is not None and root is not None:
            point = wrist + before - root
        main = {"Left": "C1", "Right": "C2"}[h]
        seen = {x[0] for x in good}
        errors = [far(point, o, d) for _, o, d in good] if point is not None else []
        if point is not None and main in seen and len(seen) > 1 and np.mean(errors) <= 0.5 and max(errors) <= 0.8:
            mode = "metric"
        elif point is not None and main in seen:
            mode = "fallback"
        else:
            mode = "rejected" if len(points[g, h, j]) > len(good) else "missing"
        r = got[g, h, j]
        assert (r["mode"], r["views"], r["rejected"]) == (mode, len(good), len(points[g, h, j]) - len(good))
        assert mode != "metric" or np.isclose(r["mean_error"], np.mean(errors), atol=2e-5)
        modes.add(mode)
    assert len(modes) >= 3


def test_ray_helpers(spark):
    one = spark.range(1)
    ray = one.select(rays.pixel_ray(*[F.lit(float(v)) for v in (420, 240, 100, 100, 320, 240)])).first()[0]
    assert np.allclose(ray, np.array([1, 0, 1]) / math.sqrt(2))
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one.select(rays.perspective(vec(1, 2, -1), vec(0, 0, 1), *[F.lit(1.0)] * 4)).first()[0] == pytest.approx([1e5 + 1, 2e5 + 1])
    turn = F.array(vec(0, -1, 0), vec(1, 0, 0), vec(0, 0, 1))
    assert one.select(rays.to_camera(vec(1, 0, 0), turn, vec(0, 0, 5))).first()[0] == [0.0, 1.0, 5.0]
    pts, none = F.array(vec(0, 0, 0), vec(3, 4, 0)), F.lit(None).cast("array<array<double>>")
    assert one.select(rays.edge_length(pts, none, 0, 1), rays.edge_length(pts, F.array(vec(0, 0, 0), vec(0, 0, 2)), 0, 1)).first()[:] == (5.0, 2.0)


def rotation(v):
    a = np.linalg.norm(v)
    k = v / a if a > 1e-12 else v * 0
    cross = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + math.sin(a) * cross + (1 - math.cos(a)) * cross @ cross


def test_pose_delta(spark):
    r = np.random.default_rng(9)
    true = np.array([0.3, -0.2, 0.5])
    v = [true + 0.01 * r.normal(size=3) for _ in range(30)] + [r.normal(size=3) for _ in range(5)]
    t = [np.array([1.0, 2.0, 3.0]) + 0.01 * r.normal(size=3) for _ in range(33)] + [np.array([9.0, 9.0, 9.0])] * 2
    df = spark.createDataFrame([("C0", rotation(a).tolist(), b.tolist()) for a, b in zip(v, t)] + [("C1", np.eye(3).tolist(), [0.0, 0.0, 0.0])], "camera_id string, rotation array<array<double>>, shift array<double>")
    back = df.select(poses.rotation_vector(F.col("rotation")).alias("v"), poses.rotation_matrix(poses.rotation_vector(F.col("rotation"))).alias("m"), "rotation").collect()
    assert all(np.allclose(np.array(x["m"]), np.array(x["rotation"]), atol=1e-9) for x in back) and np.allclose([x["v"] for x in back[:30]], v[:30], atol=1e-9)
    got = {x["camera_id"]: x for x in poses.robust_delta(df, ["camera_id"], 5.0, 0.1, 3).collect()}
    middle, shift = np.median(v, axis=0), np.median(t, axis=0)
    angle = lambda a, b: math.degrees(math.acos(min(1, max(-1, (np.trace(a @ b.T) - 1) / 2))))
    keep = [i for i in range(35) if angle(rotation(v[i]), rotation(middle)) <= 5 and np.linalg.norm(t[i] - shift) <= 0.1]
    assert got["C0"]["inliers"] == len(keep) and got["C0"]["n"] == 35
    assert np.allclose([got["C0"][f"r{a}"] for a in "xyz"], np.median([v[i] for i in keep], axis=0)) and np.allclose([got["C0"][f"t{a}"] for a in "xyz"], np.median([t[i] for i in keep], axis=0))
    assert got["C1"]["inliers"] == 1 and got["C1"]["rx"] is None


def test_pose_consistency(spark):
    r = np.random.default_rng(10)
    pose = lambda: (rotation(r.normal(size=3)), r.normal(size=3))
    cameras = {c: (*pose(), *pose()) for c in ("A", "B")}
    pairs = [(*pose(), *pose()) for _ in range(12)]
    as_list = lambda x: x.tolist()
    df = spark.createDataFrame([("B", "A", *map(as_list, p)) for p in pairs], "camera_id string, reference string, rotation array<array<double>>, shift array<double>, ref_rotation array<array<double>>, ref_shift array<double>")
    fixes = spark.createDataFrame([(c, *map(as_list, v)) for c, v in cameras.items()], "camera_id string, raw_rotation array<array<double>>, raw_shift array<double>, rotation array<array<double>>, shift array<double>")
    got = {(x["measure"], x["stage"]): x for x in poses.consistency(df, fixes).collect()}
    for stage, k in (("before", 0), ("after", 2)):
        (ra, ta), (rb, tb) = cameras["A"][k : k + 2], cameras["B"][k : k + 2]
        wrist = [np.linalg.norm(ra @ p[3] + ta - rb @ p[1] - tb) for p in pairs]
        turn = [math.degrees(math.acos(min(1, max(-1, (np.trace((ra @ p[2]) @ (rb @ p[0]).T) - 1) / 2)))) for p in pairs]
        for name, values in (("wrist", wrist), ("rotation", turn)):
            x = got[name, stage]
            assert np.allclose([x["count"], x["mean"], x["median"], x["p95"]], [12, np.mean(values), np.median(values), np.quantile(values, 0.95)])


def test_one_euro_bones(spark):
    h = fuse.root_relative(records.hands(spark, SF)).where("camera_id = 'C1' and hand = 'Left'")
    got = {r["group_id"]: np.array(r["joints"]) for r in temporal.one_euro_bones(h, ["sequence_id", "hand", "camera_id"], "group_id", "joints", fuse.BONES, min_alpha=0.2).collect()}
    rate = lambda c: 1 / (1 + 25 / (2 * math.pi * c))
    last = None
    for r in h.orderBy("group_id").collect():
        p = np.array(r["joints"])
        x = np.stack([p[0], *(p[b] - p[a] for a, b in fuse.BONES)])
        lengths = np.linalg.norm(x[1:], axis=1)
        if last is None or last[0] != r["group_id"] - 1:
            y, slope, held = x.copy(), np.zeros_like(x), lengths
        else:
            _, raw, y, slope, held = last
            slope = rate(1.0) * (x - raw) * 25 + (1 - rate(1.0)) * slope
            a = np.array([max(rate(1.5 + 0.3 * np.linalg.norm(s)), 0.2) for s in slope])[:, None]
            y = a * x + (1 - a) * y
            b = max(rate(1.5), 0.1)
            held = b * lengths + (1 - b) * held
        out = np.zeros((21, 3))
        out[0] = y[0]
        for i, (a, b) in enumerate(fuse.BONES):
            out[b] = out[a] + y[i + 1] / np.linalg.norm(y[i + 1]) * held[i]
        assert np.allclose(got[r["group_id"]], out)
        last = (r["group_id"], x, y, slope, held)


def test_gaps_that_are_asked_for(spark):
    flat = lambda v: [[float(v), float(j), 0.0] for j in range(21)]
    h = spark.createDataFrame([(0, 1, flat(0), flat(5)), (0, 4, flat(3), None), (0, 6, flat(4), flat(1))], "k int, t long, joints array<array<double>>, other array<array<double>>")
    got = {r["t"]: r for r in temporal.fill_gaps(h, ["k"], "t", 2, 9.0, 9.0, fuse.BONES, ("other",)).collect()}
    assert set(got) == {2, 3, 5} and got[2]["joints"][7] == pytest.approx([1.0, 7.0, 0.0]) and got[2]["other"] is None
    asked = spark.createDataFrame([(2,), (5,)], "t long")
    assert {r["t"] for r in temporal.fill_gaps(h, ["k"], "t", 2, 9.0, 9.0, fuse.BONES, (), asked).collect()} == {5}


def test_build_targets(spark):
    h = records.hands(spark, SF)
    got = {(r["group_id"], r["hand"]): r for r in fuse.build_targets(h, ["sequence_id", "group_id", "hand"], 0.6).collect()}

    def palm(p):
        x = p[5] - p[0]
        x = x / np.linalg.norm(x)
        z = np.cross(x, p[17] - p[0])
        z = z / np.linalg.norm(z)
        return (p - p[0]) @ np.stack([x, np.cross(z, x), z], axis=1)

    keys = {}
    for r in h.collect():
        keys.setdefault((r["group_id"], r["hand"]), []).append((-r["quality"], r["camera_id"], np.array(r["joints"])))
    assert set(got) == set(keys)
    for key, views in keys.items():
        views.sort(key=lambda v: v[:2])
        anchor = views[0]
        used = [(max(-anchor[0], 1e-3), palm(anchor[2]))]
        for q, _, p in views[1:]:
            moved, error = kabsch(p, anchor[2])
            if error <= 0.6:
                used.append((max(-q, 1e-3), palm(moved)))
        want = sum(w * p for w, p in used) / sum(w for w, _ in used)
        assert got[key]["anchor"] == anchor[1] and got[key]["used"] == len(used) and np.allclose(np.array(got[key]["target"]), want, atol=1e-9)


@pytest.mark.parametrize("order", ["group_id", "-group_id", "hash(group_id)"])
def test_first_groups_at_one_place(spark, order):
    """Of groups that tie for the last places the smaller ids count, in whatever order rows come."""
    rows = spark.range(400).selectExpr("id AS group_id", "if(id % 40 = 39, 0, 1 + id % 2) AS line").withColumn("__o", F.expr(order))
    found = records.first_groups(rows.repartitionByRange(5, "__o").sortWithinPartitions("__o").drop("__o"), "line", 16).collect()
    assert sorted(r["group_id"] for r in found) == sorted([*range(39, 400, 40), 0, 2, 4, 6, 8, 10])


def test_replay_metrics(spark):
    pairs = spark.createDataFrame([(0.9, True), (0.4, False), (0.6, False)], "iou double, is_keyframe boolean")
    reference = spark.createDataFrame([(True,)] * 2 + [(False,)] * 3, "is_keyframe boolean")
    r = B.replay_metrics(pairs, reference).first()
    assert (r["matched"], r["reference"], r["recall"], r["median"]) == (3, 5, 0.4, 0.6) and r["mean"] == pytest.approx(1.9 / 3)
    assert (r["nonkey_matched"], r["nonkey_reference"], r["nonkey_median"]) == (2, 3, 0.5) and r["nonkey_recall"] == pytest.approx(1 / 3) and r["nonkey_p10"] == pytest.approx(0.42)


def test_replay_reads_the_pairs_once(spark):
    """The match behind the pairs is dear, so it isn't run for each figure."""
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    pairs = spark.createDataFrame([(i / 100.0, i % 5 == 0) for i in range(100)], "iou double, is_keyframe boolean").mapInPandas(counted, "iou double, is_keyframe boolean")
    r = B.replay_metrics(pairs, pairs.sparkSession.createDataFrame([(True,)], "is_keyframe boolean")).first()
    assert r["median"] == pytest.approx(0.495) and r["nonkey_matched"] == 80 and seen.value == 100
    seen.value = 0
    few = B.replay_metrics(pairs, spark.createDataFrame([(True,)], "is_keyframe boolean"), wanted={}).first()
    assert few["mean"] == pytest.approx(r["mean"]) and few["nonkey_mean"] == pytest.approx(r["nonkey_mean"]) and seen.value == 100 and "median" not in few
    none = B.replay_metrics(pairs.where("iou > 5"), spark.createDataFrame([], "is_keyframe boolean")).first()
    assert none["matched"] == none["reference"] == 0 and none["recall"] is None and none["mean"] is None and none["median"] is None


def test_live_fusion(spark, tmp_path):
    df = catalog._live_rows(spark, SF)
    got = {(r["group_id"], r["hand"]): r for r in fusion.fused(df).collect()}
    rows = sorted((r.asDict() for r in df.collect()), key=lambda r: (r["sequence_id"], r["group_id"], r["camera_id"], r["hand"], r["hypothesis"] is not None, r["hypothesis"] or "", r["quality"]))
    shapes, sides_, sequence, n = {}, {}, None, 0
    for (s, g), own in itertools.groupby(rows, key=lambda r: (r["sequence_id"], r["group_id"])):
        if s != sequence:
            sequence, shapes, sides_ = s, {}, {}
        own = [r | {"joints": np.array(r["joints"])} for r in own]
        names = sorted({r["hypothesis"] for r in own if r["hypothesis"]})
        best = {}
        for r in own:
            if r["hypothesis"] is None:
                k = (r["hand"], r["camera_id"])
                best[k] = r if k not in best or r["quality"] > best[k]["quality"] else best[k]
        options = []
        for pick in itertools.product(("Right", "Left"), repeat=len(names)):
            more = [next(r for r in own if r["hypothesis"] == h and r["hand"] == p) for h, p in zip(names, pick)]
            places = [*best, *((r["hand"], r["camera_id"]) for r in more)]
            if len(set(places)) == len(places):
                cost = 0.0
                views = {h: [r["joints"] for r in [*best.values(), *more] if r["hand"] == h] for h in ("Left", "Right")}
                for h, v in views.items():
                    if v:
                        m = np.mean(v, axis=0)
                        cost += float(np.linalg.norm(np.stack(v) - m, axis=2).mean()) if len(v) > 1 else 0
                        cost += 0.35 * float(np.linalg.norm(m[[0, 5, 9, 13, 17]] - shapes[h][[0, 5, 9, 13, 17]], axis=1).mean()) if h in shapes else 0
                options.append((cost + 0.02 * (sum(bool(v) for v in views.values()) - 1), more))
        chosen = min(options, key=lambda o: o[0])[1] if options and names else []
        final = best | {(r["hand"], r["camera_id"]): r for r in chosen}
        for hand in ("Left", "Right"):
            v = [final[k] for k in sorted(final) if k[0] == hand]
            if v:
                mean = np.mean([r["joints"] for r in v], axis=0)
                r = got[g, hand]
                assert (r["views"], r["cameras"], r["resolved"]) == (len(v), ",".join(x["camera_id"] for x in v), len(chosen)) and np.allclose(np.array(r["joints"]), mean)
                shapes[hand] = mean
                n += 1
    assert n == len(got) and any(r["resolved"] for r in got.values())
    streamed = _streamed(spark, tmp_path, df, "group_id % 64 div 22 = {i}", fusion.fused_stream, "live")
    for r in streamed.collect():
        assert np.allclose(np.array(r["joints"]), np.array(got[r["group_id"], r["hand"]]["joints"]))
    assert streamed.count() == len(got)


def test_camera_files(spark, tmp_path):
    k, m = [[1.0, 0, 2], [0, 1, 3], [0, 0, 1]], [[1.0, 0, 0, 4], [0, 1, 0, 5], [0, 0, 1, 6], [0, 0, 0, 1]]
    import json

    def written(name, value):
        (tmp_path / name).write_text(json.dumps(value, indent=1))
        return str(tmp_path / name)

    i = cameras.intrinsics(spark, written("i.json", {"new_intrinsics": {"C0": k, "C1": [[1.0]], "C2": k}}))
    p = cameras.poses(spark, written("p.json", {"cameras": {"C0": {"T_H_C": m}, "C9": {"T_H_C": m}, "C2": {"T_H_C": m[:3]}}}))
    assert sorted(r[0] for r in i.collect()) == ["C0", "C2"] and [tuple(r) for r in cameras.geometry(p, i).collect()] == [("C0", k, [4.0, 5.0, 6.0], [r[:3] for r in m[:3]])]
    a = cameras.projection_corrections(spark, written("a.json", {"camera_projection_corrections": {"C0": {"affine_projected_to_rectified_px": k[:2]}, "C1": {"affine_projected_to_rectified_px": k}, "C2": None}}))
    assert [tuple(r) for r in a.collect()] == [("C0", k[:2])]
    assert [r[0] for r in cameras.pose_corrections(spark, written("d.json", {"camera_corrections": {"C0": {"delta_T_H": m}, "C1": {}}})).collect()] == ["C0"]
    assert cameras.intrinsics(spark, written("none.json", {"other": 1})).count() == 0


def test_files_and_paths(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"group_id": 4, "video_frame_index": 1, "rectified_image_path": "a/b/c.png"},\n{"group_id": 3, "video_frame_index": 0, "rectified_image_path": null}]')
    frames = records.frame_map(spark, str(tmp_path / "m.json")).orderBy("video_frame_index")
    assert [r["group_id"] for r in frames.collect()] == [3, 4]
    assert frames.select(records.image_path(F.lit("C1"), F.col("rectified_image_path"))).collect()[1][0] == "C1/c.png"
    rows = spark.createDataFrame([(i, "t" if i % 3 else "u") for i in range(20)], "pos long, type string")
    assert [r["pos"] for r in records.strided_records(rows, "t", "pos", 2, 3).collect()] == [2, 4, 8]
    df = spark.createDataFrame([("x/chunks/1/masks/m.png",), ("y/masks/n.png",), ("z.png",), (None,)], "path string")
    files = spark.createDataFrame([("old/masks/n.png",), ("b/sam3_bboxes/chunks/1/masks/m.png",)], "path string")
    got = {r["path"]: r["asset"] for r in records.existing(df, records.relocated(F.col("path"), "old", "b"), files).collect()}
    assert got == {"x/chunks/1/masks/m.png": "b/sam3_bboxes/chunks/1/masks/m.png", "y/masks/n.png": "old/masks/n.png", "z.png": None, None: None}
    assert records.synced_name("g", 1.5, 2, (3, 40)) == "g_camera_sync_g1p500_c2p000_cut_000003_000040.jsonl"
    assert [r["path"].rsplit("/", 1)[-1] for r in records.listed_files(spark, str(tmp_path / "*.json")).collect()] == ["m.json"]
    (tmp_path / "keys").mkdir()
    q = records.keyframes_stream(spark, str(tmp_path / "keys"))
    (tmp_path / "keys" / "1.jsonl").write_text('{"type":"k","group_id":1,"camera_id":"C0","hands":[{"bbox":[0,0,1,1]}]}\n')
    s = q.writeStream.format("memory").queryName("keys").option("checkpointLocation", str(tmp_path / "cp")).start()
    s.processAllAvailable()
    s.stop()
    assert [(r["group_id"], r["camera_id"]) for r in spark.table("keys").collect()] == [(1, "C0")]


def test_small_candidate_parts(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": float("nan"), "c": 3.0},), ({},), (None,)], "m map<string,double>")
    assert [r[0] for r in df.select(C.greatest_error(F.col("m"))).collect()] == [3.0, None, None]
    p = spark.createDataFrame([([1.0, 2.0, 3.0], None, "Left"), ([1.0], [0.0, 0.0, 0.0], "Right"), ([1.0], None, "Right")], "position array<double>, own array<double>, hand string")
    assert [r[0] for r in p.select(C.displayed(F.col("position"), F.col("own"), F.col("hand"), "palm-local")).collect()] == [[0.91, 2.0, 3.0], [0.09, 0.0, 0.0], None]
    boxed = spark.createDataFrame([(1, "C0", 0, [10.0, 10.0, 20.0, 20.0], None, None, None)], "group_id long, camera_id string, at int, box array<double>, label string, label_source string, confidence double")
    job = C.online_jobs(boxed, 2.0, 100, 100).first()
    assert job["box"] == [5.0, 5.0, 25.0, 25.0] and job["label"] == "unknown" and job["label_source"] == "sam3_only_unknown" and job["is_right"] is None
    marks = spark.createDataFrame([(1, [[0.0, 1.0]], 0.9)], "k int, points array<array<double>>, score double")
    assert [r["landmark_score"] for r in C.attached(spark.createDataFrame([(1,), (2,)], "k int"), marks, ["k"]).orderBy("k").collect()] == [0.9, None]

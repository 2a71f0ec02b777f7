import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from kinespark.operators import boxes, fit, fuse, hypotheses, temporal
from kinespark.plans import catalog
from kinespark.sources import records
from kinespark.streaming import filters, labels, online


def test_ranges():
    assert records.parse_ranges("3-9, 12") == [(3, 9), (12, 12)]
    assert records.parse_ranges("") == []
    with pytest.raises(ValueError):
        records.parse_ranges("9-3")


def test_strict_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"group_id":0,"camera_id":"C0","hands":[]}\n\n{"group_id":1,"camera_id":"C1","hands":[{"hand_index":0,"handedness":"Left"}]}\n')
    read = records.read_jsonl(spark, str(tmp_path / "a.jsonl"), records.HANDS)
    assert read.count() == 2 and records.explode_hands(read).select("handedness").collect()[0][0] == "Left"
    (tmp_path / "b.jsonl").write_text('{"group_id":0}\nnot json\n')
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "b.jsonl"), records.HANDS).collect()


def test_merge(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    c = spark.createDataFrame([(2, "other")], "k int, v string")
    assert sorted(map(tuple, records.strict_merge([a, b], ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, records.merge_shards([a, c], ["k"]).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="conflicting"):
        records.strict_merge([a, c], ["k"]).collect()


def test_bidirectional_ema(spark):
    x = [random.Random(1).random() for _ in range(50)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, t int, x double")
    got = [r[0] for r in temporal.bidirectional_ema(df, ["k"], "t", "x", 0.3).orderBy("t").select("x").collect()]

    def ema(v):
        out = [v[0]]
        for y in v[1:]:
            out.append(0.3 * y + 0.7 * out[-1])
        return out

    want = [(a + b) / 2 for a, b in zip(ema(x), ema(x[::-1])[::-1])]
    assert np.allclose(got, want)


def test_one_euro(spark):
    rows = [(1, t, math.sin(t), math.cos(t)) for t in [*range(10), *range(13, 20)]]
    got = temporal.one_euro(spark.createDataFrame(rows, "k int, t int, x double, y double"), ["k"], "t", ["x", "y"]).orderBy("t").collect()
    alpha = lambda c: 1 / (1 + 25 / (2 * math.pi * c))
    last = None
    for r, g in zip(rows, got):
        v = np.array(r[2:])
        if last is None or r[1] != last + 1:
            out, slope = v, np.zeros(2)
        else:
            slope = alpha(1.0) * (v - raw) * 25 + (1 - alpha(1.0)) * slope  # noqa: F821
            a = alpha(1.5 + 0.3 * np.linalg.norm(slope))
            out = a * v + (1 - a) * out
        raw, last = v, r[1]  # noqa: F841
        assert np.allclose([g["x"], g["y"]], out)


def test_matching_rules(spark):
    schema = "group_id long, camera_id string, n int, box array<double>, score double, origin string"
    rows = [
        (0, "C0", 1, [0.0, 0.0, 10.0, 10.0], 0.5, "mediapipe"),
        (0, "C0", 2, [1.0, 1.0, 11.0, 11.0], 0.9, "sam3"),
        (0, "C0", 3, [0.0, 0.0, 10.0, 10.0], 0.2, "sam3"),
        (0, "C0", 4, [1.0, 1.0, 11.0, 11.0], 0.4, "mediapipe"),
    ]
    df = spark.createDataFrame(rows, schema)
    assert {(r["first"], r["second"]) for r in boxes.greedy_global(df).collect()} == {(1, 3), (4, 2)}
    assert {(r["first"], r["second"]) for r in boxes.optimal(df).collect()} == {(1, 3), (4, 2)}


def test_similarity_recovers(spark):
    r = np.random.default_rng(0)
    a = r.normal(size=(40, 3))
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    b = 1.7 * a @ q.T + [1, 2, 3]
    df = spark.createDataFrame([(1, *map(float, x), *map(float, y)) for x, y in zip(a, b)], "k int, x double, y double, z double, tx double, ty double, tz double")
    row = fit.similarity_moments(df, ["k"]).first().asDict()
    s, rot, t = fit.similarity(row)
    assert np.isclose(s, 1.7) and np.allclose(rot, q) and np.allclose(t, [1, 2, 3])
    assert fit.similarity_error(df, ["k"]).first()["after"] < 1e-9


def test_ridge(spark):
    v = catalog._vectors(spark, SF)
    mean, dev, w, b = fit.ridge(v, "embedding", "label", 64, 1.0)
    p = v.toPandas()
    x, y = np.stack(p.embedding).astype(float), p.label.to_numpy(float)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(64), z.T @ (y - y.mean()))
    assert np.allclose(w, want, atol=1e-6) and np.isclose(b, y.mean())


def test_vote_automaton(spark):
    state = labels.START
    for _ in range(3):
        state = labels.step(state, "Left", 1.0)
    assert state[0] == "Left"
    for i in range(5):
        state = labels.step(state, "Right", 2.0)
    assert state[0] == "Right" and state[4] == 0.7
    assert labels.step(state, None, 9.0) == state


def test_stream_equals_batch(spark, tmp_path):
    v = spark.createDataFrame(
        [("C0", t % 3, t, "Left" if (t * 7) % 5 < 3 else "Right", float(1 + t % 3)) for t in range(90)], "camera_id string, track_id long, t long, vote string, weight double"
    )
    for i in range(3):
        v.where(f"t between {30 * i} and {30 * i + 29}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = labels.locked_labels_stream(stream).writeStream.format("memory").queryName("labels").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r["camera_id"], r["track_id"], r["t"])
    assert sorted(map(tuple, spark.table("labels").collect())) == sorted(map(tuple, labels.locked_labels(v).collect()))


def test_medoid_is_the_least_distant_view(spark):
    rows = fuse.root_relative(records.hands(spark, SF)).collect()
    keys = {}
    for r in rows:
        keys.setdefault((r["group_id"], r["hand"]), []).append((r["camera_id"], max(r["quality"], 0.05), np.array(r["joints"])))
    for r in catalog.fuse_medoid(spark, SF).collect():
        views = keys[r["group_id"], r["hand"]]
        cost = {c: sum(w * np.linalg.norm(p - q, axis=1).mean() for _, w, q in views) / sum(w for _, w, _ in views) for c, _, p in views}
        assert abs(cost[r["camera_id"]] - min(cost.values())) < 1e-9 and abs(cost[r["camera_id"]] - r["cost"]) < 1e-6


def test_sensor_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2\nframe,x\n1,0.5\n2,bad\n")
    (tmp_path / "b.csv").write_text("frame,x\n1,0.5\n")
    (tmp_path / "c.csv").write_text("2\nframe\n2\n2\n")  # rows that look like the count line
    (tmp_path / "d.csv").write_text("3\nframe\n1\n2\n")
    read = lambda *names: records.read_sensor_csv(spark, [str(tmp_path / f"{n}.csv") for n in names])
    assert [tuple(r) for r in read("a").orderBy("frame").collect()] == [(1.0, 0.5), (2.0, None)]
    assert [tuple(r) for r in read("b").collect()] == [(1.0, 0.5)]
    assert [tuple(r) for r in read("c").collect()] == [(2.0,), (2.0,)]
    assert sorted(tuple(r) for r in read("a", "c").select("frame").collect()) == [(1.0,), (2.0,), (2.0,), (2.0,)]
    with pytest.raises(ValueError, match="declared"):
        read("d")


def test_malformed_line_names_its_file(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"group_id":0}\nnot json\n')
    with pytest.raises(Exception, match=r"x\.jsonl at line not json"):
        records.read_jsonl(spark, str(tmp_path / "x.jsonl"), records.HANDS).collect()


def test_csv_sink(spark, tmp_path):
    records.write_csv(spark.createDataFrame([(1, 0.5, "a,b"), (2, None, None)], "frame long, x double, name string").coalesce(1), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, schema="frame long, x double, name string")
    assert sorted(map(tuple, back.collect())) == [(1, 0.5, "a,b"), (2, None, None)]


def test_axis_affine(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=60), r.normal(size=60)
    tx, ty = 1.2 * x + 0.3, 0.9 * y - 0.2
    df = spark.createDataFrame([(1, *map(float, v)) for v in zip(x, y, tx, ty)], "k int, x double, y double, tx double, ty double")
    row = fit.axis_affine(df, ["k"]).first()
    assert np.allclose([row["ax"], row["bx"], row["ay"], row["by"]], [1.2, 0.3, 0.9, -0.2])


def test_triangulate_subsets(spark):
    """Three rays through one point and one that misses it: the subset of three wins."""
    point, rows = np.array([0.1, 0.2, 2.0]), []
    for i, o in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)]):
        d = point - o + (np.array([0.5, 0, 0]) if i == 3 else 0)
        rows.append((1, f"C{i}", *map(float, o), *map(float, d / np.linalg.norm(d))))
    rays = spark.createDataFrame(rows, "k int, camera_id string, ox double, oy double, oz double, dx double, dy double, dz double")
    best = fit.triangulate_best(rays, ["k"], ["C0", "C1", "C2", "C3"], F.lit("C0")).first()
    assert best["views"] == 3 and best["valid"] and np.allclose([best["x"], best["y"], best["z"]], point)
    assert fit.triangulate_best(rays, ["k"], ["C0", "C1", "C2", "C3"], F.lit("C9")).count() == 0  # without the primary camera nothing
    far = fit.triangulate_best(rays, ["k"], ["C0", "C1", "C2", "C3"], F.lit("C3"), far=0.1).first()
    assert not far["valid"] and far["reason"] == "depth"
    same = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0), (1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)], "k int, ox double, oy double, oz double, dx double, dy double, dz double")
    r = fit.triangulate(same, ["k"]).first()
    a = 2 * np.diag([1, 1, 0])
    assert np.allclose([r["x"], r["y"], r["z"]], np.linalg.lstsq(a, np.array([1.0, 0, 0]), rcond=None)[0]) and np.isclose(r["error"], 0.5)


def test_aligned_error(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=(21, 3))
    turn, _ = np.linalg.qr(r.normal(size=(3, 3)))
    turn[:, 0] *= np.linalg.det(turn)
    rows = [(a.tolist(), (a @ turn + [1.0, 2.0, 3.0]).tolist()), (a.tolist(), (a * [1, 1, -1]).tolist())]
    got = [x[0] for x in spark.createDataFrame(rows, "a array<array<double>>, b array<array<double>>").select(fuse.aligned_error("a", "b")).collect()]
    assert got[0] < 1e-9 and got[1] > 0.1  # a reflection is no rotation


def test_consensus_errors(spark):
    r = np.random.default_rng(3)
    views = {c: r.normal(size=(21, 3)) for c in ("C0", "C1", "C2")}
    rows = [(0, 1, "Left", c, v.tolist()) for c, v in views.items()] + [(0, 2, "Left", "C0", views["C0"].tolist())]
    h = spark.createDataFrame(rows, "sequence_id long, group_id long, hand string, camera_id string, joints array<array<double>>")
    got = {(x["group_id"], x["camera_id"]): x["error"] for x in fuse.consensus_errors(h).collect()}

    def error(a, b):
        p, q = a - a.mean(0), b - b.mean(0)
        u, _, vt = np.linalg.svd(p.T @ q)
        turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        return np.linalg.norm(p @ turn - q, axis=1).mean()

    want = {c: np.median([error(views[c], v) for o, v in views.items() if o != c]) for c in views}
    assert got.pop((2, "C0")) is None
    assert all(abs(got[1, c] - want[c]) < 1e-9 for c in views)


def test_smooth_rotations(spark):
    r = np.random.default_rng(4)
    given = [np.linalg.qr(r.normal(size=(3, 3)))[0] for _ in range(12)]
    given = [np.stack([g[0], g[1], np.cross(g[0], g[1])]) for g in given]
    df = spark.createDataFrame([(1, i, g.tolist()) for i, g in enumerate(given)], "k int, t int, axes array<array<double>>")
    got = [np.array(x["axes"]) for x in temporal.smooth_rotations(df, ["k"], "t", "axes", 0.4).orderBy("t").collect()]
    held = given[0]
    assert np.allclose(got[0], held)
    for g, w in zip(got[1:], given[1:]):
        a, b = 0.4 * w[0] + 0.6 * held[0], 0.4 * w[1] + 0.6 * held[1]
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        held = np.stack([a, b / np.linalg.norm(b), np.cross(a, b / np.linalg.norm(b))])
        assert np.allclose(g, held) and np.allclose(g @ g.T, np.eye(3))


def _streamed(spark, tmp_path, df, split, query, name):
    for i in range(3):
        df.where(split.format(i=i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = query(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_one_euro_stream(spark, tmp_path):
    rows = [(k, t, f"T{t // 13}", math.sin(t + k), math.cos(t)) for k in range(2) for t in range(30) if t not in (7, 8)]
    df = spark.createDataFrame(rows, "k long, t long, track string, x double, y double")
    got = _streamed(spark, tmp_path, df, "t div 10 = {i}", lambda s: filters.one_euro_stream(s, ["k"], "t", ["x", "y"], "track"), "euro")
    want = temporal.one_euro(df, ["k"], "t", ["x", "y"], "track")
    got, want = (sorted(map(tuple, f.select("k", "t", "x", "y").collect())) for f in (got, want))
    assert len(want) == len(rows) and np.allclose(got, want)
    fresh = {(k, t): (x, y) for k, t, x, y in want}
    assert fresh[0, 13] == (math.sin(13), math.cos(13)) and fresh[1, 9] == (math.sin(10), math.cos(9))


def test_online_labels(spark, tmp_path):
    tracks = {}
    job = lambda g, n, track, label, score=0.5, key=True: ("C0", g, n, track, label, score, key)
    assert [r[4:] for r in online.step(tracks, [job(0, 0, 1, "Left", 0.4), job(0, 1, 2, "Left", 0.9)])] == [("Left", "hypothesis"), ("Right", "hypothesis"), ("Left", "observed")]
    assert [r[4:] for r in online.step(tracks, [job(1, 0, 2, "Right")])] == [("Left", "held")]
    assert [r[4:] for r in online.step(tracks, [job(2, 0, 2, "Right", key=False)])] == [("Left", "held")]
    assert [r[4:] for r in online.step(tracks, [job(3, 0, 2, None)])] == [("Left", "inherited")]
    assert [r[4:] for r in online.step(tracks, [job(4, 0, 2, "Right")])] == [("Right", "observed")]
    rows = [(f"C{c}", g, n, (g + n) % 3 if (g * 5 + n) % 7 else None, ("Left", "Right", None)[(g * 3 + n * 2 + c) % 3], (g * 7 + n) % 10 / 10.0, g % 2 == 0) for c in range(2) for g in range(30) for n in range(3)]
    df = spark.createDataFrame(rows, "camera_id string, group_id long, job long, track_id long, observed string, score double, keyframe boolean")
    got = _streamed(spark, tmp_path, df, "group_id div 10 = {i}", online.online_labels_stream, "online")
    assert sorted(map(str, got.collect())) == sorted(map(str, online.online_labels(df).collect()))


def test_knuckles_and_corrections(spark):
    from kinespark.functions import scores
    from kinespark.functions import vectors as V

    flat = [[0.0, 0.0, 0.0]] * 21
    one = spark.createDataFrame([(flat, [3.0, 4.0])], "joints array<array<double>>, q array<double>")
    got = one.select(
        V.knuckle_axes(F.col("joints")).alias("axes"), V.inverse_affine(F.col("q"), [[1, 2, 0], [2, 4, 0]]).alias("same"), V.project(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)), 1, 1, 0, 0).alias("behind"),
        scores.overlap_score(F.lit(1.0), F.lit(2.0), F.lit(4.0)).alias("overlap"), scores.overlap_score(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("none"),
    ).first()
    assert got["axes"] is None and got["same"] == [3.0, 4.0] and got["behind"] is None
    assert abs(got["overlap"] - (0.45 / 5 + 0.45 / 2 + 0.1 / 4)) < 1e-12 and got["none"] == 0.0


def test_hypotheses():
    r = np.random.default_rng(6)
    for trial in range(40):
        cameras = [f"C{i}" for i in range(3)]
        row = lambda c, hand, name: {"camera_id": c, "hand": hand, "hypothesis": name, "quality": r.random(), "joints": r.normal(size=(21, 3)), "history": None}
        rows = [row(c, h, None) for c in cameras for h in ("Left", "Right") if r.random() < 0.3]
        names = [(f"h{i}", cameras[r.integers(3)]) for i in range(1 + trial % 4)]
        rows += [row(c, h, n) for n, c in names for h in ("Left", "Right")]
        if trial % 2:
            past = r.normal(size=(21, 3))
            rows = [x | {"history": past if x["hand"] == "Left" else None} for x in rows]
        past = {x["hand"]: x["history"] for x in rows if x["history"] is not None}
        held = [x for x in rows if x["hypothesis"] is None]
        best = None
        for sides in itertools.product(("Right", "Left"), repeat=len(names)):
            own = [next(x for x in rows if x["hypothesis"] == n and x["hand"] == s) for (n, _), s in zip(names, sides)]
            places = [(x["hand"], x["camera_id"]) for x in held + own]
            if len(set(places)) == len(places):
                views = {h: np.stack([x["joints"] for x in held + own if x["hand"] == h]) for h in {x["hand"] for x in held + own}}
                cost = 0.02 * (len(views) == 2) + sum(np.linalg.norm(v - v.mean(axis=0), axis=2).mean() for v in views.values())
                cost += sum(0.35 * np.linalg.norm((v.mean(axis=0) - past[h])[[0, 5, 9, 13, 17]], axis=1).mean() for h, v in views.items() if h in past)
                best = min(best, (cost, sides), key=lambda b: b[0]) if best else (cost, sides)
        got = hypotheses.choose(rows)
        assert [g[0] for g in got] == [n for n, _ in names]
        if best:
            assert tuple(g[1] for g in got) == best[1] and all(g[4] and abs(g[3] - best[0]) < 1e-12 for g in got)
        else:
            assert all(g[1:] == ("Right", c, None, False) for g, (_, c) in zip(got, names))


def test_ambiguous_hands(spark):
    got = catalog.ambiguous_hands(spark, SF).collect()
    open_ = records.hands(spark, SF).where("pos % 5 = 0").count()
    assert len(got) == open_ and all(r["hand"] in ("Left", "Right") and (r["cost"] is not None) == r["resolved"] for r in got)

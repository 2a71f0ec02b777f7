"""Numbered lines over many splits, followed files, and poses from pixels."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.operators import pnp
from kinespark.sources import lines

REC = "type string, v long"


def _write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        f.write(end.join(rows))


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_numbered_lines(spark, tmp_path, small_splits):
    want = []
    for name, n in (("a.jsonl", 200), ("b.jsonl", 3), ("c.jsonl", 90)):
        rows, position = [], 0
        for i in range(n):
            if i % 7 == 3 and n > 5:
                rows.append("" if i % 2 else "   ")
                continue
            row = json.dumps({"type": "t" if i % 3 else "u", "v": i, "pad": "x" * (i % 50)})
            rows.append(row)
            want.append((name, i + 1, position, row))
            position += 1
        _write(tmp_path / name, rows, "\n" if name != "c.jsonl" else "\r\n")
    found = lines.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted((os.path.basename(r.file), r.line, r.position, r.value.strip()) for r in found.collect()) == sorted(want)
    records = lines.read_numbered_jsonl(spark, str(tmp_path), REC)
    kept = lines.strided(records, 3, kind="t").collect()
    direct = [(n, p) for n, _, p, row in want if p % 3 == 0 and json.loads(row)["type"] == "t"]
    assert sorted((os.path.basename(r.file), r.position) for r in kept) == sorted(direct)
    first = lines.strided(records, 2, 5).collect()
    assert [(os.path.basename(r.file), r.position) for r in first] == [("a.jsonl", p) for p in (0, 2, 4, 6, 8)]


def test_malformed_line_names_its_number(spark, tmp_path, small_splits):
    rows = [json.dumps({"type": "t", "v": i, "pad": "y" * 40}) for i in range(60)]
    rows.insert(10, "")
    rows[47] = '{"type": "t", "v": '
    _write(tmp_path / "x.jsonl", rows)
    with pytest.raises(Exception, match=r"Invalid JSON at .*x\.jsonl:48 "):
        lines.read_numbered_jsonl(spark, str(tmp_path), REC).collect()


def test_following_files(spark, tmp_path, monkeypatch):
    folder, checkpoint = tmp_path / "in", str(tmp_path / "c")
    folder.mkdir()
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    seen = []

    def run() -> list[int]:
        before = len(seen)

        def keep(batch, _):
            seen.extend((os.path.basename(r.file), r.byte, r.v) for r in batch.collect())

        stream = lines.following_jsonl(spark, str(folder), REC)
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()  # the same checkpoint: a restart each time
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(v for *_, v in seen[before:])

    a.write_text('{"type": "t", "v": 1}\n{"type": "t", "v"')
    assert run() == [1]
    assert run() == []
    with a.open("a") as f:
        f.write(': 2}\n\n')
    assert run() == [2]
    b.write_text("".join(json.dumps({"type": "é" * 30, "v": 100 + i}) + "\n" for i in range(500)) + '{"half')
    assert run() == list(range(100, 600))
    with a.open("a") as f:
        f.write('{"type": "t", "v": 3}\n')
    assert run() == [3]
    text = {n: (folder / n).read_bytes() for n in ("a.jsonl", "b.jsonl")}
    assert all(json.loads(text[n][at:].split(b"\n")[0])["v"] == v for n, at, v in seen) and len(set(seen)) == len(seen)


def test_followed_ranges_cover_lines_once(tmp_path, monkeypatch):
    for name, value in (("RANGE", 37), ("LOOK", 16)):
        monkeypatch.setattr(lines, name, value)
    rows = ["x" * (i * 13 % 90) + str(i) for i in range(80)]
    (tmp_path / "r.jsonl").write_text("\n".join(rows) + "\nhalf")
    reader = lines._Follower({"path": str(tmp_path)})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    got = [r for p in parts for r in reader.read(p)]
    assert [v for *_, v in got] == rows and len(parts) > 20
    middle = {got[30][0]: got[30][1]}
    assert [v for p in reader.partitions(middle, end) for *_, v in reader.read(p)] == rows[30:]
    (tmp_path / "r.jsonl").write_text("short\n")
    with pytest.raises(ValueError, match="shorter"):
        reader.latestOffset()


def _poses(n, flat, noise, seed=0):
    draw = np.random.default_rng(seed)
    body = draw.normal(0, 0.05, (n, 21, 3))
    body[..., 2] *= flat
    r = np.linalg.qr(draw.normal(size=(n, 3, 3)))[0]
    r[:, :, 0] *= np.sign(np.linalg.det(r))[:, None]
    t = np.c_[draw.uniform(-0.2, 0.2, (n, 2)), draw.uniform(0.3, 1.5, n)]
    camera = np.tile([600.0, 580, 320, 240], (n, 1))
    p = np.einsum("nij,npj->npi", r, body) + t[:, None]
    pixels = p[..., :2] / p[..., 2:] * camera[:, None, :2] + camera[:, None, 2:] + draw.normal(0, noise, (n, 21, 2))
    on = draw.random((n, 21)) < 0.7
    on[:, :6] = True
    return body, pixels, on, camera, r, t


@pytest.mark.parametrize("flat", [1.0, 0.05, 0.0])
def test_poses_are_found_again(flat):
    body, pixels, on, camera, r, t = _poses(200, flat, 0.0)
    found = pnp.solve(body, pixels, on, camera)
    assert np.abs(found[1] - t).max() < 1e-6 and np.abs(found[0] - r).max() < 1e-6 and found[2].max() < 1e-6


def test_noisy_poses_are_stationary():
    """No turn or shift nearby leaves fewer pixels."""
    body, pixels, on, camera, _, _ = _poses(20, 1.0, 0.5, 3)
    r, t, _ = pnp.solve(body, pixels, on, camera)

    def cost(r, t):
        p = np.einsum("nij,npj->npi", r, body) + t[:, None]
        off = p[..., :2] / p[..., 2:] * camera[:, None, :2] + camera[:, None, 2:] - pixels
        return ((off**2).sum(axis=-1) * on).sum(axis=1)

    best = cost(r, t)
    for k in range(6):
        for step in (1e-4, -1e-4):
            e = np.zeros((20, 3))
            e[:, k % 3] = step
            assert (cost(pnp._turned(e) @ r if k < 3 else r, t if k < 3 else t + e) >= best - 1e-9).all()


def test_pose_gates(spark):
    body, pixels, _, _, _, t = _poses(1, 1.0, 0.0, 5)
    b, p, cam, one = body[0].tolist(), pixels[0].tolist(), [600.0, 580.0, 320.0, 240.0], [1.0] * 21
    holes = [None, [1.0, None, 2.0], [float("nan")] * 3, *b[3:]]
    rows = [
        (0, b, p, one, cam), (1, b, p, None, cam), (2, b, p, [1.0] * 5, cam), (3, b, p[::-1], one, cam), (4, b, p, one, None), (5, None, p, one, cam), (6, b, None, one, cam), (7, holes, p, one, cam),
        (8, b, p, [None, *one[1:]], cam), (9, b, p, one, [600.0, None, 1.0, 1.0]), (0, b, p, one, cam), (None, [], [], [], cam),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, body array<array<double>>, pixels array<array<double>>, confidence array<double>, camera array<double>, status string")
    got = {}
    for r in pnp.pose_from_points(df, pnp.Gates(0.5, 5.0)).collect():
        got.setdefault(r.id, []).append(r)
    assert {k: v[0].status for k, v in got.items()} == {0: "estimated", 1: "estimated", 2: "few_points", 3: "far_off", 4: "no_camera", 5: "few_points", 6: "few_points", 7: "estimated", 8: "estimated", 9: "no_camera", None: "few_points"}
    assert len(got[0]) == 2 and all(np.allclose(r.shift, t[0], atol=1e-7) for k in (0, 1, 7, 8) for r in got[k]) and got[3][0].shift is None
    assert pnp.pose_from_points(df.limit(0)).count() == 0


def test_initial_pose_falls_back(spark):
    body, pixels, _, _, r, t = _poses(1, 1.0, 0.0, 6)
    turn, origin = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [1.0, 2.0, 3.0]
    seen = (body[0] @ r[0].T).tolist()
    cam = [600.0, 580.0, 320.0, 240.0]
    rows = [(0, body[0].tolist(), pixels[0].tolist(), cam), (1, body[0].tolist(), pixels[0].tolist()[:4], cam)]
    df = spark.createDataFrame([(*x, None, turn, origin, seen, [0.1, 0.2, 0.9]) for x in rows], "id int, body array<array<double>>, pixels array<array<double>>, camera array<double>, confidence array<double>, rig_rotation array<array<double>>, origin array<double>, seen_body array<array<double>>, wrist array<double>")
    got = {r.id: r for r in pnp.initial_pose(df).collect()}
    assert got[0].source == "physical_pnp" and got[1].source == "virtual_camera"
    for k, shift in ((0, t[0]), (1, np.array([0.1, 0.2, 0.9]))):
        assert np.allclose(got[k].rotation, np.array(turn) @ r[0], atol=1e-6) and np.allclose(got[k].shift, np.array(turn) @ shift + origin, atol=1e-6)


def test_camera_correction(spark):
    """A camera moved by a known turn and shift is put back, by hands that both cameras posed."""
    draw = np.random.default_rng(9)
    delta = pnp._turned(np.array([[0.03, -0.02, 0.05]]))[0], np.array([0.02, -0.01, 0.03])
    rig = {"C0": (np.eye(3), np.zeros(3)), "C1": (pnp._turned(np.array([[0.0, 0.4, 0.0]]))[0], np.array([0.3, 0.0, 0.0]))}
    true = {"C0": rig["C0"], "C1": (delta[0] @ rig["C1"][0], delta[0] @ rig["C1"][1] + delta[1])}
    rows = []
    for g in range(30):
        r, p = pnp._turned(draw.normal(size=(1, 3)))[0], draw.normal(0, 0.2, 3) + [0, 0, 1]
        for c, (rc, tc) in true.items():
            away = draw.normal(0, 0.3, 3) if g % 7 == 3 and c == "C1" else np.zeros(3)
            rows.append((g, "Left", c, (rc.T @ r).tolist(), (rc.T @ (p - tc) + away).tolist()))
    seen = spark.createDataFrame(rows, "group_id long, hand string, camera_id string, rotation array<array<double>>, shift array<double>")
    table = spark.createDataFrame([(c, r.tolist(), t.tolist()) for c, (r, t) in rig.items()], "camera_id string, rotation array<array<double>>, origin array<double>")
    deltas = pnp.camera_deltas(seen, table, {"Left": "C0", "Right": "C0"}, ["group_id"])
    fixes = pnp.camera_corrections(deltas.where("group_id % 2 = 0"), 5.0, 0.1, 3)
    (fix,) = fixes.collect()
    assert fix.status == "estimated" and fix.inliers < fix.n == 15
    assert np.allclose(fix.rotation, delta[0], atol=1e-9) and np.allclose(fix.shift, delta[1], atol=1e-9)
    found = {(r.measure, r.stage): r for r in pnp.held_out(deltas.where("group_id % 2 = 1"), table, fixes).collect()}
    assert found["wrist", "after"].median < 1e-9 < 0.01 < found["wrist", "before"].median and found["rotation", "after"].median < 1e-3 < found["rotation", "before"].median
    few = pnp.camera_corrections(deltas, 5.0, 0.1, 300)
    assert [(r.status, r.rotation) for r in few.collect()] == [("insufficient_consistent_inliers", None)]
    assert pnp.held_out(deltas.where(F.lit(False)), table, few).count() == 0

"""The queries take all rows; operators of matching, neighbours and series against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from kinespark.operators import boxes, fit, temporal
from kinespark.plans import catalog
from kinespark.sources import records

def test_every_line_is_a_detection(spark):
    lines = records.table(spark, SF, "lineitem")
    n = lines.count()
    assert records.detections(spark, SF).count() == n == catalog.bbox_features(spark, SF).count()
    kept = {(r["group_id"], r["n"]) for r in catalog.bbox_suppress(spark, SF).collect()}
    assert {g for g, _ in kept} == {r[0] for r in lines.select("l_orderkey").distinct().collect()}


def test_knn_across_blocks(spark, monkeypatch):
    """Many blocks, a third of the vectors equal (ties go to the smaller id), odd rows left out."""
    monkeypatch.setattr(fit, "KNOWN", 40)
    monkeypatch.setattr(fit, "ASKED", 30)
    r = np.random.default_rng(3)
    x = [[1.0, 2.0, 3.0] if i % 3 == 0 else r.normal(size=3).tolist() for i in range(200)]
    odd = [(1000, None, 1), (1001, [float("nan"), 0.0, 0.0], 1), (1002, [], 1)]
    v = spark.createDataFrame([(i, e, i % 7) for i, e in enumerate(x)] + odd, "id long, f array<double>, y int")
    got = {q["id"]: (q["predicted"], q["nearest"]) for q in fit.knn(v, v, "f", "y", 5).collect()}
    assert set(got) == set(range(200))
    a = np.array(x)
    for i in range(200):
        d = np.round(np.sqrt(((a - a[i]) ** 2).mean(axis=1)), 12)
        best = [j for j in np.lexsort((np.arange(200), d)) if j != i][:5]
        w = np.exp(-0.5 * (d[best] / max(d[best].max(), 1e-6)) ** 2)
        assert np.allclose(got[i], (w @ (np.array(best) % 7) / w.sum(), d[best].min()))


BOX_ROWS = "group_id long, camera_id string, n int, box array<double>, score double, origin string, label string, label_source string, is_right double"


def test_matches_beyond_the_fifth(spark):
    """The sixth and seventh box of either origin match; all first boxes stay."""
    at = lambda i: [100.0 * i, 0.0, 100.0 * i + 10, 10.0]
    rows_ = [(0, "C0", i + 7 * k, at(i), 0.5, o, "Left", "x", 0.0) for i in range(1, 8) for k, o in enumerate(("mediapipe", "sam3"))]
    df = spark.createDataFrame(rows_, BOX_ROWS)
    assert {(r["first"], r["second"]) for r in boxes.optimal(df).collect()} == {(i, i + 7) for i in range(1, 8)}
    assert {(r["first"], r["second"]) for r in boxes.hand_jobs(df).collect()} == {(i, i + 7) for i in range(1, 8)}


def test_suppression_keeps_apart_what_is_apart(spark):
    far, near = [500.0, 500.0, 500.0, 500.0], [0.0, 0.0, 10.0, 10.0]
    rows_ = [(0, "C0", 1, near, 0.1, "a", "Left", "tracker", 0.0), (0, "C0", 2, far, 0.9, "a", "Left", "tracker", 0.0), (0, "C0", 3, near, 0.9, "a", "Left", "prompt", 1.0), (0, "C0", 4, near, 0.9, "a", "Left", "hypothesis", 1.0)]
    got = {r["n"]: (r["label_source"], r["is_right"]) for r in boxes.suppress(spark.createDataFrame(rows_, BOX_ROWS)).collect()}
    assert got == {1: ("prompt", 1.0), 2: ("tracker", 0.0), 4: ("hypothesis", 1.0)}  # an empty box and a hypothesis stay, the first takes the trusted side


def test_assignment_is_the_best_of_all():
    r = np.random.default_rng(5)
    for case in range(300):
        n = int(r.integers(1, 5))
        gain = r.random((n, int(r.integers(n, 7)))) * (r.random() < 0.5 or r.integers(0, 2, 1))
        gain = np.round(gain, 1) if case % 3 == 0 else gain
        found = boxes._assigned(gain)
        assert len(set(found)) == n
        best = max(sum(gain[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(gain.shape[1]), n))
        assert abs(gain[range(n), found].sum() - best) < 1e-9


def test_long_series_streams(spark):
    """No array of a series; a null key is a key, equal times go by value, a null value stays null."""
    r = np.random.default_rng(2)
    x = r.random(5000).tolist()
    data = [(None, i // 2, v) for i, v in enumerate(x)] + [(1, 0, 1.0), (1, 1, None), (1, 2, 3.0)]
    found = temporal.bidirectional_ema(spark.createDataFrame(data, "k int, t int, x double"), ["k"], "t", "x", 0.3)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = found.collect()
    assert len(got) == len(data) and [g["x"] for g in got if g["k"] == 1] == [None] * 3
    v = [p[1] for p in sorted((i // 2, u) for i, u in enumerate(x))]

    def ema(a):
        out = [a[0]]
        for y in a[1:]:
            out.append(0.3 * y + 0.7 * out[-1])
        return out

    want = sorted((i // 2, (a + b) / 2) for i, (a, b) in enumerate(zip(ema(v), ema(v[::-1])[::-1], strict=True)))
    assert np.allclose(sorted((g["t"], g["x"]) for g in got if g["k"] is None), want)


@pytest.mark.parametrize("name", ["causal_ema", "one_euro"])
def test_all_series(spark, name):
    """A row for each point of each hand; each series as the operator has it alone."""
    n = records.hands(spark, SF).count() * 21
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got) == n * (3 if name == "causal_ema" else 1)
    assert set(got["joint"]) == set(range(21)) and set(got["camera_id"]) == {"C0", "C1", "C2", "C3"}
    h = records.joint_rows(records.hands(spark, SF)).where("camera_id = 'C2' and joint = 13").toPandas()
    for (sequence, hand), one in h.sort_values("group_id").groupby(["sequence_id", "hand"]):
        mine = got[(got["sequence_id"] == sequence) & (got["hand"] == hand) & (got["camera_id"] == "C2") & (got["joint"] == 13)].sort_values("group_id")
        if name == "causal_ema":
            want, last = [], None
            for t, y in zip(one["group_id"], one["y"], strict=True):
                want.append(0.6 * y + 0.4 * want[-1] if last == t - 1 else y)
                last = t
            assert np.allclose(mine[mine["axis"] == "y"]["x"], want, atol=1e-6)
        else:
            state, want = None, []
            for t, *x in one[["group_id", "x", "y", "z"]].itertuples(index=False):
                state = temporal.one_euro_step(state, t, np.array([x]), None)
                want.append(state[3][0])
            assert np.allclose(mine[["x", "y", "z"]], want, atol=1e-6)


def test_all_fits(spark):
    found = catalog.axis_affine(spark, SF).toPandas()
    assert len(found) == 3 * 2 * 21 == len(found[["camera_id", "hand", "joint"]].drop_duplicates())
    main = "camera_id = case hand when 'Left' then 'C1' else 'C2' end"
    n = sum(1 for r in records.hands(spark, SF).groupBy("group_id", "hand").agg(F.count("*").alias("n"), F.max(F.expr(main)).alias("main")).collect() if r["main"] and r["n"] > 1)
    assert catalog.triangulate_subsets(spark, SF).select("group_id", "hand", "joint").distinct().count() == n * 21


def test_optimal_takes_keys_of_all_shapes_together(spark):
    """Against all permutations; keys with boxes of one origin have no pairs, odd ones no row."""
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for g in range(150):
        own = []
        for n in range(int(rng.integers(1, 9))):
            x, y = (rng.integers(0, 60, 2) * 1.0).tolist()
            own.append((g, f"C{g % 3}", n, [x, y, x + 20 + n, y + 30], ("mediapipe", "sam3", "other")[int(rng.choice(3, p=[0.45, 0.45, 0.1]))]))
        rows += own
        a, b = ([r for r in own if r[4] == o] for o in ("mediapipe", "sam3"))
        few, many = sorted((a, b), key=len)
        best = max(sum(boxes._iou(x[3], y[3]) for x, y in zip(few, p, strict=True)) for p in itertools.permutations(many, len(few)))
        if few:
            want[g] = (len(few), round(best, 9))
    df = spark.createDataFrame(rows, "group_id int, camera_id string, n int, box array<double>, origin string").repartition(3)
    found = {}
    kinds = {(r[0], r[2]): r for r in rows}
    for r in boxes.optimal(df).collect():
        a, b = kinds[r["group_id"], r["first"]], kinds[r["group_id"], r["second"]]
        assert (a[4], b[4], a[1]) == ("mediapipe", "sam3", r["camera_id"]) and r["iou"] == boxes._iou(a[3], b[3])
        found.setdefault(r["group_id"], []).append((r["first"], r["second"], r["iou"]))
    assert {g: (len(v), round(sum(x[2] for x in v), 9)) for g, v in found.items()} == want and len(want) > 90
    assert all(len({x[0] for x in v}) == len({x[1] for x in v}) == len(v) for v in found.values())
    gain = rng.random((300, 3, 5)) * (rng.random((300, 3, 5)) < 0.5)
    together = boxes._assigned_all(gain)
    assert all((boxes._assigned(x) == y).all() for x, y in zip(gain, together, strict=True))

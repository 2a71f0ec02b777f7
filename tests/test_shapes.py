"""Weighted medians of vectors and pixel sets against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.functions import masks as M
from kinespark.operators import shapes

W, H = 40, 30


def _median(x, w, share=0.5):
    out = []
    for d in range(x.shape[1]):
        order = np.argsort(x[:, d], kind="stable")
        run = np.cumsum(w[order])
        out.append(x[order, d][np.searchsorted(run, share * w.sum() - 1e-12)])
    return np.array(out)


@pytest.mark.parametrize("buffer", [10**6, 7])
def test_sequence_shape(spark, buffer):
    """A third of the rows in one group; the two ways agree with NumPy."""
    draw = np.random.default_rng(1)
    rows = [(int(g), int(i), [float(v) for v in draw.normal(0, 2, 6).round(int(i) % 3)], float(s)) for i, (g, s) in enumerate(zip(np.where(draw.random(900) < 1 / 3, 0, draw.integers(1, 30, 900)), draw.integers(-2, 50, 900) / 8))]
    df = spark.createDataFrame([*rows, (99, 1000, None, 1.0), (98, 1001, [1.0] * 6, None)], "key long, id long, shape array<double>, score double")
    for most in (40, 10**6):
        got = {r.key: r for r in shapes.sequence_shape(df, ["key"], "shape", "score", most, ["id"], buffer).collect()}
        assert set(got) == {r[0] for r in rows}
        for k in got:
            own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[3], r[1]))[:most]
            want = np.clip(_median(np.array([r[2] for r in own]), np.array([max(r[3], 1e-3) for r in own])), -3, 3)
            assert got[k]["count"] == len(own) and np.array_equal(got[k].shape, want)


def test_weighted_quantile_of_hard_rows(spark):
    df = spark.createDataFrame([(None, [1.0, None], 1.0), (None, [2.0, float("nan")], 5.0), (1, None, 1.0), (1, [3.0, 3.0], None), (2, [7.0, 7.0], 1.0), (2, [7.0, 7.0], 1.0)], "key long, v array<double>, w double")
    got = {r.key: (r["count"], r.v) for r in shapes.weighted_quantile(df, ["key"], "v", "w").collect()}
    assert got == {None: (2, [2.0]), 2: (2, [7.0, 7.0])}
    assert shapes.weighted_quantile(df.limit(0), ["key"], "v", "w").count() == 0


def _dense(runs):
    flat = np.zeros(W * H, bool)
    for r in runs:
        flat[r["start"] : r["stop"]] = True
    return flat.reshape(H, W)


def test_masks(spark):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(60):
        boxes = [[*(lo := draw.uniform(-5, [W, H])).tolist(), *(lo + draw.uniform(0, 20, 2)).tolist()] for _ in range(2)]
        rows.append((i, *boxes, draw.uniform(-3, [W + 3, H + 3], (6, 2)).tolist(), draw.uniform(-3, [W + 3, H + 3], (5, 2)).tolist()))
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>, hull array<array<double>>, points array<array<double>>")
    df = df.withColumn("ma", M.of_box(F.col("a"), W, H)).withColumn("mb", M.joined(F.concat(M.of_box(F.col("b"), W, H), M.of_hull(F.col("hull"), W, H))))
    found = df.select(
        "*", M.area(F.col("mb")).alias("area"), M.shared(F.col("ma"), F.col("mb")).alias("both"), M.scores(F.col("ma"), F.col("mb")).alias("s"), M.containment(F.col("ma"), F.col("mb")).alias("c"),
        M.box(F.col("mb"), W).alias("box"), M.share_inside(F.col("mb"), F.col("points"), W, H).alias("inside"), M.mean_distance(M.with_rows(F.col("mb"), W), F.col("points"), W, H).alias("far"), M.of_hull(F.col("hull"), W, H).alias("h"),
    )
    xs, ys = np.meshgrid(np.arange(W) + 0.5, np.arange(H) + 0.5)
    for r in found.collect():
        x1, y1, x2, y2 = r.a
        a, b = _dense(r.ma), _dense(r.mb)
        assert np.array_equal(a, (xs >= x1) & (xs < x2) & (ys >= y1) & (ys < y2))
        pts = np.array(r.hull)
        hull = np.ones_like(a)  # inside: on one side of every pair that has all points there
        for i in range(6):
            for j in range(6):
                n = np.array([pts[j][1] - pts[i][1], pts[i][0] - pts[j][0]])
                if i != j and ((pts - pts[i]) @ n <= 1e-9).all():
                    hull &= (xs - pts[i][0]) * n[0] + (ys - pts[i][1]) * n[1] <= 1e-9
        assert np.array_equal(_dense(r.h), hull)
        assert all(p["stop"] < q["start"] for p, q in zip(r.mb, r.mb[1:]))
        both, union = (a & b).sum(), (a | b).sum()
        assert (r.area, r.both) == (b.sum(), both)
        part = lambda n: both / n if n else 0.0
        assert np.allclose([r.s.iou, r.s.reference_coverage, r.s.candidate_coverage, r.s.score], [part(union), part(a.sum()), part(b.sum()), 0.45 * part(union) + 0.45 * part(a.sum()) + 0.1 * part(b.sum())])
        assert np.isclose(r.c, part(min(a.sum(), b.sum())))
        yy, xx = np.nonzero(b)
        assert r.box == ([xx.min(), yy.min(), xx.max(), yy.max()] if len(xx) else None)
        own = [(x, y) for x, y in r.points if 0 <= x < W and 0 <= y < H]
        at = lambda x, y: (min(max(round(x), 0), W - 1), min(max(round(y), 0), H - 1))
        assert np.isclose(r.inside, np.mean([b[at(x, y)[::-1]] for x, y in own]) if own else 0.0)
        if len(xx):
            far = [np.hypot(xx - at(x, y)[0], yy - at(x, y)[1]).min() if (x, y) in own else W / 4 for x, y in map(tuple, r.points)]
            assert np.isclose(r.far, np.mean(far))
        else:
            assert r.far is None


def test_masks_of_nothing(spark):
    none = F.lit(None).cast(M.KIND)
    empty = F.array().cast(M.KIND)
    row = spark.range(1).select(M.containment(none, empty).alias("a"), M.containment(empty, empty).alias("b"), M.area(empty).alias("c"), M.box(empty, 5).alias("d"), M.share_inside(none, F.array(F.array(F.lit(1.0), F.lit(1.0))), 5, 5).alias("e"), M.of_box(F.lit(None).cast("array<double>"), 5, 5).alias("f"), M.scores(empty, empty)["score"].alias("g")).first()
    assert tuple(row) == (0.0, 0.0, 0, None, None, None, 0.0)

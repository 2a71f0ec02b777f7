"""Fitted corrections: moments are Spark aggregates; only they reach the driver, which solves a
small system and applies it as an expression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles


def joint_offsets(pairs: DataFrame, k: float = 20.0, most: float = 0.3) -> DataFrame:
    """Mean residual (true less predicted) of each joint, shrunk by n / (n + k), then cut to
    the length `most`. pairs: joint, x y z, tx ty tz."""
    means = pairs.groupBy("joint").agg(F.count("*").alias("n"), *[F.avg(F.col(f"t{c}") - F.col(c)).alias(c) for c in "xyz"])
    shrink = F.col("n") / (F.col("n") + k)
    means = means.select("joint", "n", *[(F.col(c) * shrink).alias(c) for c in "xyz"])
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    cut = F.least(F.lit(1.0), F.lit(most) / F.greatest(size, F.lit(1e-12)))
    return means.select("joint", "n", *[(F.col(c) * cut).alias(c) for c in "xyz"])


def bone_scales(pairs: DataFrame, k: float = 20.0, low: float = 0.7, high: float = 1.4, keys: list[str] | None = None) -> DataFrame:
    """Median ratio of true to predicted length of each bone (of both over 1e-6), shrunk to 1 by
    n / (n + k), then cut to [low, high]. pairs: keys, bone, length, true_length."""
    by = [*(keys or []), "bone"]
    good = pairs.where("length > 1e-6 and true_length > 1e-6").select(*by, (F.col("true_length") / F.col("length")).alias("ratio"))
    found = good.groupBy(*by).agg(F.count("*").alias("n")).join(quantiles.exact(good, by, "ratio", {"m": 0.5}), by)
    w = F.col("n") / (F.col("n") + k)
    return found.select(*by, "n", F.greatest(F.lit(low), F.least(F.lit(high), 1 + w * (F.col("m") - 1))).alias("scale"))


def similarity_moments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Count, means and cross sums that a similarity fit needs, one row a key."""
    crosses = [F.covar_pop(a, f"t{b}").alias(f"c{a}{b}") for a in "xyz" for b in "xyz"]
    variance = (F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("variance")
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.avg(f"t{c}").alias(f"mt{c}") for c in "xyz"], *crosses, variance)


def similarity(row: dict, scale: bool = True, shift: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """(s, R, t) of the least-squares similarity from one row of similarity_moments(); s is 1
    without `scale`, t zero without `shift`."""
    cov = np.array([[row[f"c{a}{b}"] for a in "xyz"] for b in "xyz"])
    u, d, vt = np.linalg.svd(cov)
    sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    r = u @ np.diag(sign) @ vt
    s = float((d * sign).sum() / row["variance"]) if scale and row["variance"] > 0 else 1.0
    t = np.array([row[f"mt{c}"] for c in "xyz"]) - s * r @ np.array([row[f"m{c}"] for c in "xyz"]) if shift else np.zeros(3)
    return s, r, t


def apply_similarity(df: DataFrame, fitted: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    s, r, t = fitted
    moved = {c: sum((F.col(a) * float(s * r[i, j]) for j, a in enumerate("xyz")), F.lit(float(t[i]))) for i, c in enumerate("xyz")}
    return df.withColumns(moved)


def similarity_error(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, before, after): RMS error of the pairs before and after the fitted similarity
    of their key; the fit is one small row a key, joined back and applied as an expression."""
    from pyspark.sql import types as T

    fields = T.StructType([T.StructField("m", T.ArrayType(T.DoubleType()))])
    moments = similarity_moments(pairs, keys)

    def solved(frames):
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                s, r, t = similarity(row)
                rows.append([float(v) for v in np.r_[(s * r).ravel(), t]])
            yield frame[keys].assign(m=rows)

    schema = T.StructType([*[moments.schema[k] for k in keys], *fields.fields])
    fitted = pairs.join(moments.mapInPandas(solved, schema), keys)
    m = lambda i: F.get("m", F.lit(i))
    new = [sum((F.col(a) * m(3 * i + j) for j, a in enumerate("xyz")), m(9 + i)) for i in range(3)]
    after = sum(((n - F.col(f"t{c}")) * (n - F.col(f"t{c}")) for n, c in zip(new, "xyz", strict=True)), F.lit(0.0))
    before = sum(((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in "xyz"), F.lit(0.0))
    return fitted.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(before)).alias("before"), F.sqrt(F.avg(after)).alias("after"))


def ridge(df: DataFrame, features: str, target: str, dims: int, alpha: float, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, deviation, weights, intercept) by normal equations on standardised features (a
    deviation under 1e-8 counts as 1) with a free intercept, for a number or, with `width`, an
    array of numbers as target. The second moments, (dims + width + 1) squared numbers, are one
    aggregate and all that comes to the driver."""
    size = dims + width + 1

    def partial(batches):
        i, j = np.indices((size, size)).reshape(2, -1)
        for batch in batches:
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) for c in ("x", "y"))
            whole = np.c_[x, y, np.ones(len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array((whole.T @ whole).ravel())], ["i", "j", "v"])

    y = F.col(target).cast("array<double>") if width > 1 else F.array(F.col(target).cast("double"))
    rows = df.select(F.col(features).cast("array<double>").alias("x"), y.alias("y")).mapInArrow(partial, "i int, j int, v double")
    sums = np.zeros((size, size))
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r["i"], r["j"]] = r["v"]
    n, total = sums[-1, -1], sums[dims:-1, -1]
    mean = sums[:dims, -1] / n
    second = sums[:dims, :dims] / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(second), 0))
    deviation[deviation < 1e-8] = 1.0
    gram = n * second / np.outer(deviation, deviation)
    moment = (sums[:dims, dims:-1] - np.outer(mean, total)) / deviation[:, None]
    weights, intercept = np.linalg.solve(gram + alpha * np.eye(dims), moment), total / n
    return (mean, deviation, weights, intercept) if width > 1 else (mean, deviation, weights[:, 0], intercept[0])


def predict(features: str, model: tuple) -> Column:
    """The prediction of ridge() for a number as target."""
    mean, deviation, w, b = model
    slope = w / deviation
    weights = F.array(*[F.lit(float(v)) for v in slope])
    return F.aggregate(F.zip_with(F.col(features).cast("array<double>"), weights, lambda a, c: a * c), F.lit(float(b - mean @ slope)), lambda s, v: s + v)


#: Prototypes of a block and queries of a group of knn().
KNOWN, ASKED = 8192, 4096


def _nearest(k: int, bandwidth: float, kind: type, width: int):
    """Mean of each query's k nearest. Values are vectors. The rows of a group come in order of `part`: its queries
    first (one row for each length of features), then every block of prototypes, of which a
    query keeps the best k so far."""

    def meet(held: tuple, ids: np.ndarray, x: np.ndarray, values: np.ndarray) -> None:
        q_ids, q, d_best, p_best, v_best = held
        norms, dims, most = (x * x).sum(axis=1), x.shape[1], min(k, len(ids)) - 1
        for at in range(0, len(q), 64):
            part = q[at : at + 64]
            own = (part * part).sum(axis=1)
            rough = own[:, None] + norms[None, :] - 2 * (part @ x.T)
            rough[q_ids[at : at + 64, None] == ids[None, :]] = np.inf
            slack = 1e-12 * (own + norms.max())
            last = np.sqrt(np.maximum(np.partition(rough, most, axis=1)[:, most], 0) + slack)
            # what can still be among the k once distances are exact and rounded
            last = np.minimum(last, d_best[at : at + 64, -1] * np.sqrt(dims)) + 2e-12 * np.sqrt(dims)
            able = (rough <= (last**2 + slack)[:, None]) & np.isfinite(rough)
            for i in np.flatnonzero(able.any(axis=1)):
                near, z = np.flatnonzero(able[i]), at + i
                d = np.r_[d_best[z], np.round(np.sqrt(((x[near] - part[i]) ** 2).sum(axis=1) / dims), 12)]
                p, v = np.r_[p_best[z], ids[near]], np.concatenate([v_best[z], values[near]])
                best = np.lexsort((p, d))[:k]
                d_best[z], p_best[z], v_best[z] = d[best], p[best], v[best]

    def means(held: dict) -> Iterator[pa.RecordBatch]:
        for q_ids, _, d, _, v in held.values():
            found = np.isfinite(d)
            h = np.maximum(np.where(found, d, 0).max(axis=1) * bandwidth, 1e-6)[:, None]
            w = np.where(found, np.exp(-0.5 * (np.where(found, d, 0) / h) ** 2), 0)
            some = found[:, 0]
            sums = (np.where(np.isnan(v), 0, v) * w[:, :, None]).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-300)[:, None]
            sums[~(found[:, :, None] & ~np.isnan(v)).any(axis=1)] = np.nan
            lists = pa.ListArray.from_arrays(pa.array(np.arange(some.sum() + 1) * width, pa.int32()), pa.array(sums[some].ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[some]), lists, pa.array(d[some, 0])], ["id", "predicted", "nearest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if group != row["g"]:
                    yield from means(held)
                    group, held = row["g"], {}
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], kind).reshape(-1, row["dims"]).astype(float)
                if row["part"] == 0:
                    held[row["dims"]] = ids, x, np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64), np.full((len(ids), k, width), np.nan)
                elif row["dims"] in held:
                    meet(held[row["dims"]], ids, x, np.frombuffer(row["v"], np.float64).reshape(-1, width))
        yield from means(held)

    return run


def _block(kind: type):
    def pack(key, table):
        """Rows (id, x, v) of one block and length of features as one packed row."""
        number, dims = (v.as_py() for v in key)
        x, v = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(t) for c, t in (("x", kind), ("v", np.float64)))
        ids = table.column("id").to_numpy().astype(np.int64)
        return pa.table({"b": pa.array([number], pa.int32()), "dims": pa.array([dims], pa.int32()), "ids": [ids.tobytes()], "x": [x.tobytes()], "v": [v.tobytes()]})

    return pack


def knn(queries: DataFrame, prototypes: DataFrame, features: str, value: str, k: int, bandwidth: float = 1.0) -> DataFrame:
    """(id, predicted, nearest): mean of the k nearest prototypes' values under a Gaussian of
    their RMS distance, with the k-th distance times `bandwidth` (1e-6 at least) as its width; a
    row isn't its own neighbour. `value` is a number or an array of numbers of one length, and so
    is `predicted`. The numbers of groups of queries and of blocks of prototypes follow the
    rows; a task streams every block past a group and returns one row a query, never pairs.
    Features that are null, empty or not finite take no part, and only those of equal length
    are compared."""
    kind = np.float32 if all(df.schema[features].dataType.simpleString() == "array<float>" for df in (queries, prototypes)) else np.float64
    many = prototypes.schema[value].dataType.simpleString().startswith("array")
    first = prototypes.where(F.col(value).isNotNull()).select(F.size(value) if many else F.lit(1)).first()
    width = first[0] if first else 1

    def rows(df: DataFrame, v: Column) -> DataFrame:
        fine = F.col(features).isNotNull() & (F.size(features) > 0) & F.forall(features, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
        return df.where(fine).select("id", F.col(features).alias("x"), v.alias("v"))

    def blocks(df: DataFrame, n: int) -> DataFrame:
        at = F.pmod(F.xxhash64("id", "x"), F.lit(n)).cast("int")
        return df.groupBy(at.alias("b"), F.size("x").alias("dims")).applyInArrow(_block(kind), "b int, dims int, ids binary, x binary, v binary")

    none = F.array().cast("array<double>")
    known = rows(prototypes, F.coalesce(F.col(value).cast("array<double>") if many else F.array(F.col(value).cast("double")), F.array_repeat(F.lit(None).cast("double"), width)))
    asked = rows(queries, none)
    groups, lots = max(1, -(-asked.count() // ASKED)), max(1, -(-known.count() // KNOWN))
    payload = ["dims", "ids", "x", "v"]
    ask = blocks(asked, groups).select(F.col("b").alias("g"), F.lit(0).alias("part"), *payload)
    rest = blocks(known, lots).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("part"), *payload)
    tasks = max(groups, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    work = ask.unionByName(rest).repartition(tasks, "g").sortWithinPartitions("g", "part")
    found = work.mapInArrow(_nearest(k, bandwidth, kind, width), "id long, predicted array<double>, nearest double")
    return found if many else found.withColumn("predicted", F.get("predicted", F.lit(0)))


def ood_gate(df: DataFrame, nearest: str, train: DataFrame, full: float = 0.75, zero: float = 0.99, least: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """df with `gate`: 1 up to the `full` quantile of train's nearest distances, `least` from the
    `zero` quantile on (1e-8 over the former at least), linear between; within `keys`."""
    edges = quantiles.exact(train, list(keys or []), nearest, {"__a": full, "__b": zero}).withColumn("__b", F.greatest("__b", F.col("__a") + 1e-8))
    if keys:
        joined = df.join(edges, keys)
    else:  # one row of two quantiles
        joined = df.withColumn("__one", F.lit(1)).join(F.broadcast(edges.withColumn("__one", F.lit(1))), "__one").drop("__one")
    ramp = (F.col("__b") - F.col(nearest)) / (F.col("__b") - F.col("__a"))
    return joined.withColumn("gate", F.least(F.lit(1.0), F.greatest(F.lit(float(least)), ramp))).drop("__a", "__b")


def huber_shift(pairs: DataFrame, keys: list[str], delta: float = 0.2, most: float = 1.0, rounds: int = 3) -> DataFrame:
    """(keys, sx, sy): the shift of x, y towards tx, ty by reweighted means: in the first round all
    weigh 1, then a residual r of the round before weighs min(1, delta / r); each round's shift is
    cut to [-most, most]."""
    dx, dy = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    rows, w = pairs, F.lit(1.0)
    for i in range(max(1, rounds)):
        shift = {c: F.greatest(F.lit(-most), F.least(F.lit(most), F.sum(w * d) / F.sum(w))) for c, d in (("sx", dx), ("sy", dy))}
        found = rows.groupBy(*keys).agg(*[v.alias(c) for c, v in shift.items()])
        rows = pairs.join(found, keys)
        rest = F.sqrt((dx - F.col("sx")) * (dx - F.col("sx")) + (dy - F.col("sy")) * (dy - F.col("sy")))
        w = 1 / F.greatest(F.lit(1.0), rest / max(delta, 1e-6))
    return found


def triangulate(rays: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, views, x, y, z, error): the point nearest to all rays (ox oy oz, directions dx dy dz
    of any length) of a key, by Cramer's rule on summed normal equations, and the mean distance
    from the rays. Where all rays are parallel every point of a line is nearest, and that
    closest to the origin is taken."""
    rays = normalised(rays)
    d = lambda a, b: F.lit(1.0 if a == b else 0.0) - F.col(f"d{a}") * F.col(f"d{b}")
    sums = [F.sum(d(a, b)).alias(f"m{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    right = [F.sum(d(a, "x") * F.col("ox") + d(a, "y") * F.col("oy") + d(a, "z") * F.col("oz")).alias(f"r{a}") for a in "xyz"]
    s = rays.groupBy(*keys).agg(F.count("*").alias("views"), *sums, *right)
    c = {a + b: F.col("m" + min(a + b, b + a)) for a in "xyz" for b in "xyz"}

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    full = [[c[a + b] for b in "xyz"] for a in "xyz"]
    swapped = [[[F.col("r" + a) if j == i else full[k][j] for j in range(3)] for k, a in enumerate("xyz")] for i in range(3)]
    good = F.abs(det(full)) > 1e-14 * F.pow("views", 3)
    points = s.select(*keys, "views", *[F.when(good, det(m) / det(full)).otherwise(F.col(f"r{n}") / F.col("views")).alias(n) for m, n in zip(swapped, "xyz", strict=True)])
    return rays.join(points, keys).groupBy(*keys, "views", "x", "y", "z").agg(F.avg(distance()).alias("error"))


def normalised(rays: DataFrame) -> DataFrame:
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return rays.withColumns({f"d{a}": F.col(f"d{a}") / size for a in "xyz"})


def along() -> Column:
    """How far along a ray (unit dx dy dz) the foot of the point x y z lies."""
    return sum(((F.col(n) - F.col(f"o{n}")) * F.col(f"d{n}") for n in "xyz"), F.lit(0.0))


def distance() -> Column:
    """Distance of the point x y z from a ray's line."""
    foot = along()
    return F.sqrt(sum(((F.col(n) - F.col(f"o{n}") - foot * F.col(f"d{n}")) * (F.col(n) - F.col(f"o{n}") - foot * F.col(f"d{n}")) for n in "xyz"), F.lit(0.0)))


def axis_affine(pairs: DataFrame, keys: list[str], scale: float = 2.0, slope: float = 0.5, shift: float = 1.0, rounds: int = 3) -> DataFrame:
    """(keys, ax, bx, ay, by): tx = ax * x + bx and ty = ay * y + by by reweighted least squares.
    A point whose residual is over `scale` weighs scale / residual in the next round; slopes
    stay within `slope` of 1, shifts within `shift` of 0. Each round is one aggregation."""
    found = pairs.select(*keys).distinct().withColumns({"ax": F.lit(1.0), "bx": F.lit(0.0), "ay": F.lit(1.0), "by": F.lit(0.0)})
    for i in range(rounds):
        rest = F.sqrt(sum((((F.col(f"a{c}") * F.col(c) + F.col(f"b{c}") - F.col(f"t{c}")) * (F.col(f"a{c}") * F.col(c) + F.col(f"b{c}") - F.col(f"t{c}"))) for c in "xy"), F.lit(0.0)))
        rows = pairs.join(found, keys).withColumn("w", 1 / F.greatest(F.lit(1.0), rest / scale) if i else F.lit(1.0))
        w = F.col("w")
        sums = rows.groupBy(*keys).agg(F.sum(w).alias("n"), *[F.sum(w * v).alias(f"{name}{c}") for c in "xy" for name, v in (("s", F.col(c)), ("t", F.col(f"t{c}")), ("q", F.col(c) * F.col(c)), ("p", F.col(c) * F.col(f"t{c}")))])
        lines = {}
        for c in "xy":
            spread = F.col("n") * F.col(f"q{c}") - F.col(f"s{c}") * F.col(f"s{c}")
            a = F.when(F.abs(spread) > 1e-12, (F.col("n") * F.col(f"p{c}") - F.col(f"s{c}") * F.col(f"t{c}")) / spread).otherwise(1.0)
            lines[f"a{c}"] = F.greatest(F.lit(1 - slope), F.least(F.lit(1 + slope), a))
            lines[f"b{c}"] = F.greatest(F.lit(-shift), F.least(F.lit(shift), (F.col(f"t{c}") - a * F.col(f"s{c}")) / F.col("n")))
        found = sums.select(*keys, *[v.alias(k) for k, v in lines.items()])
    return found


def triangulate_best(rays: DataFrame, keys: list[str], cameras: list[str], primary: Column | None = None, least: int = 2, mean: float = 0.05, most: float = 0.08, near: float = 0.0, far: float = 10.0) -> DataFrame:
    """(keys, subset, views, x, y, z, error, worst, valid, reason): the best of all camera subsets
    of a key with `least` views or more that have its primary camera (an expression over the
    keys; a key without that camera has no row). A subset is valid if every depth along its rays
    lies in [near, far] and its mean and greatest distance from the rays are within `mean` and
    `most`. Of valid ones more views come first, then smaller errors. Without a valid one the best
    of the rest is there with the reason: errors before depths, then those within each limit,
    then smaller errors. The subsets of the few cameras of a rig are a fixed list."""
    from itertools import combinations

    subsets = [list(s) for n in range(least, len(cameras) + 1) for s in combinations(cameras, n)]
    options = F.array(*[F.struct(F.lit(i).alias("subset"), F.lit(len(s)).alias("wanted")) for i, s in enumerate(subsets)])
    members = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in subsets]), F.col("subset") + 1)
    every = normalised(rays).withColumn("o", F.explode(options)).select(*rays.columns, "o.*").where(F.array_contains(members, F.col("camera_id")))
    if primary is not None:
        every = every.where(F.array_contains(members, primary))
    every = every.withColumn("got", F.count("*").over(Window.partitionBy(*keys, "subset"))).where("got = wanted")
    points = triangulate(every, [*keys, "subset"]).drop("error")
    joined = every.join(points, [*keys, "subset"])
    scored = joined.groupBy(*keys, "subset", "views", "x", "y", "z").agg(F.avg(distance()).alias("error"), F.max(distance()).alias("worst"), F.min(along()).alias("low"), F.max(along()).alias("high"))
    deep = ~((F.col("low") >= near) & (F.col("high") <= far))
    reason = F.when(deep, "depth").when((F.col("error") > mean) | (F.col("worst") > most), "ray_error")
    scored = scored.withColumn("reason", reason).withColumn("valid", reason.isNull())
    rejected = [F.when(~F.col("valid"), c).otherwise(F.lit(False)) for c in (deep, F.col("error") > mean, F.col("worst") > most)]
    order = Window.partitionBy(*keys).orderBy(F.desc("valid"), F.desc(F.when(F.col("valid"), F.col("views")).otherwise(0)), *rejected, F.round("error", 9), F.round("worst", 9), "subset")
    return scored.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "low", "high")

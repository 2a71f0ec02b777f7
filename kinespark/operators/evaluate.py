"""Scores of predictions against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles

#: The finger of each of the 21 points.
FINGERS = ["wrist", *(f for f in ("thumb", "index", "middle", "ring", "little") for _ in range(4))]


def finger(joint: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in FINGERS]), joint + 1)


def joint_errors(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, joint, finger, error): distance of each predicted point from the true one, where
    both sides have the key."""
    other = truth.select(*keys, "joint", *[F.col(c).alias(f"t{c}") for c in "xyz"])
    square = sum(((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in "xyz"), F.lit(0.0))
    return predicted.join(other, [*keys, "joint"]).select(*keys, "joint", finger(F.col("joint")).alias("finger"), F.sqrt(square).alias("error"))


def statistics(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, n, mean, median, rmse, p90, p95, max) of a column by group; see quantiles.exact()."""
    c = F.col(column)
    sums = df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.sqrt(F.avg(c * c)).alias("rmse"), F.max(c).alias("max"))
    return sums.join(quantiles.exact(df, keys, column, {"median": 0.5, "p90": 0.9, "p95": 0.95}), keys)


def summary(errors: DataFrame) -> DataFrame:
    """Statistics over all rows and by hand, finger, joint, and hand with finger."""
    sets = [[], ["hand"], ["finger"], ["joint"], ["hand", "finger"]]
    kind = dict(errors.dtypes)
    one = lambda s: F.struct(F.lit("_".join(s) or "overall").alias("level"), *[(F.col(c) if c in s else F.lit(None).cast(kind[c])).alias(c) for c in ("hand", "finger", "joint")])
    rows = errors.select(F.explode(F.array(*map(one, sets))).alias("s"), "error").select("s.*", "error")
    named = rows.withColumn("__k", F.concat_ws("/", "level", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("hand", "finger", "joint")]))
    labels = named.groupBy("__k").agg(*[F.first(c).alias(c) for c in ("level", "hand", "finger", "joint")])
    return labels.join(statistics(named, ["__k"], "error"), "__k").drop("__k")


def gain_by_bucket(base: DataFrame, gated: DataFrame, keys: list[str]) -> DataFrame:
    """Gain in error of gated over base by quality bucket: count, mean, median, and share
    of gains over 1e-9 (less is rounding)."""
    joined = base.select(*keys, "bucket", F.col("error").alias("was")).join(gated.select(*keys, F.col("error").alias("now")), keys)
    rows = joined.select("bucket", (F.col("was") - F.col("now")).alias("gain"))
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("gain").alias("mean"), F.avg((F.col("gain") > 1e-9).cast("double")).alias("positive"))
    return sums.join(quantiles.exact(rows, ["bucket"], "gain", {"median": 0.5}), "bucket")


def recall(pairs: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Share of rows whose `iou` reaches the threshold, and the overlap's mean, median, p10."""
    rows = pairs.withColumn("__v", F.coalesce("iou", F.lit(0.0)))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("__v") >= threshold).cast("double")).alias("recall"), F.avg("__v").alias("mean"))
    return sums.join(quantiles.exact(rows, keys, "__v", {"median": 0.5, "p10": 0.1}), keys)


def residual_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, points, mean, median, p95, max): distances of x, y from tx, ty."""
    d = F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))
    rows = pairs.select(*keys, d.alias("d"))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("points"), F.avg("d").alias("mean"), F.max("d").alias("max"))
    return sums.join(quantiles.exact(rows, keys, "d", {"median": 0.5, "p95": 0.95}), keys)


def ratios(df: DataFrame, keys: list[str], parts: dict[str, Column]) -> DataFrame:
    """(keys, n, one share of rows for each part): counts of detections as shares; 0 where a key
    has no rows that count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.count_if(c) / F.greatest(F.count("*"), F.lit(1))).alias(name) for name, c in parts.items()])

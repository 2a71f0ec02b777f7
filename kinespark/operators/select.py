"""Selections: argmax by an explicit total order, strides, chunks, votes, label repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order; ties are the caller's to break."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def best_view(df: DataFrame, keys: list[str], score: str, position: str) -> DataFrame:
    """Highest score of each key, the earliest position on ties."""
    return first_by(df, keys, [F.desc(score), F.asc(position)])


def parity(df: DataFrame, odd: bool) -> DataFrame:
    return df.where(F.col("group_id") % 2 == int(odd))


def stride_by_group(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("group_id") % n == 0)


#: Ids of a range that one task ranks.
RANGE = 4096


def ranked(df: DataFrame, keys: list[str], order: str, name: str, ties: list[str] = []) -> DataFrame:
    """df with each row's rank from 0 within its keys (null is none) by `order`, an integer, then
    `ties`. Ranges of ids are counted first and ranked by themselves, so that few keys make as
    many tasks as many."""
    ranged = df.withColumn("__range", F.floor(F.col(order) / RANGE))
    counts = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(order, *ties))
    return ranged.withColumn("__own", own).join(counts, [*keys, "__range"]).withColumn(name, F.col("__before") + F.col("__own") - 1).drop("__range", "__before", "__own")


def stride_by_rank(df: DataFrame, keys: list[str], order: list[str], n: int, offset: int = 0) -> DataFrame:
    """Every n-th row of each key in order (an integer first), from `offset` on."""
    return ranked(df, keys, order[0], "__rank", order[1:]).where(F.col("__rank") % n == offset).drop("__rank")


def chunks(groups: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, chunk, low, high, n): ordered distinct group ids in chunks of `size`."""
    dealt = ranked(groups.select(*keys, "group_id").distinct(), keys, "group_id", "__rank").withColumn("chunk", F.floor(F.col("__rank") / size))
    return dealt.groupBy(*keys, "chunk").agg(F.min("group_id").alias("low"), F.max("group_id").alias("high"), F.count("*").alias("n"))


def repair_pair_labels(df: DataFrame, keys: list[str], label: str, score: str, position: str) -> DataFrame:
    """Where a key has exactly two rows with one label, the lower score (on a tie the later
    row) gets the other label."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.desc(score), F.asc(position)))
    twins = (F.count("*").over(w) == 2) & (F.min(label).over(w) == F.max(label).over(w))
    other = F.when(F.col(label) == "Left", "Right").when(F.col(label) == "Right", "Left").otherwise(F.col(label))
    marked = df.withColumn("__twins", twins).withColumn("__rank", rank)
    return marked.withColumn(label, F.when(F.col("__twins") & (F.col("__rank") == 2), other).otherwise(F.col(label))).drop("__twins", "__rank")


def majority(df: DataFrame, keys: list[str], label: str, weight: str) -> DataFrame:
    """(keys, label, weight): the label of greatest total weight, ties by label."""
    votes = df.groupBy(*keys, label).agg(F.sum(weight).alias("weight"))
    return first_by(votes, keys, [F.desc(F.round("weight", 9)), F.asc(label)])


def spatial_labels(df: DataFrame, keys: list[str], centre: str, position: str) -> DataFrame:
    """Left and Right by centre where a key has exactly two rows; null elsewhere."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(centre, position))
    return df.withColumn("label", F.when(F.count("*").over(w) == 2, F.when(rank == 1, "Left").otherwise("Right")))


def anchor_with_margin(df: DataFrame, keys: list[str], score: str, canonical: str, margin: float) -> DataFrame:
    """The best-scored camera of each key, but the canonical one while the best isn't more than
    `margin` above it."""
    w = Window.partitionBy(*keys)
    own = F.max(F.when(F.col("camera_id") == canonical, F.col(score))).over(w)
    marked = df.withColumn("__keep", F.max(score).over(w) <= own + margin)
    return first_by(marked, keys, [F.desc(F.coalesce("__keep", F.lit(False)) & (F.col("camera_id") == canonical)), F.desc(score), F.asc("camera_id")]).drop("__keep")


def prefer(base: DataFrame, gated: DataFrame, keys: list[str], value: str, gate: Column) -> DataFrame:
    """base with `value` replaced by that of gated where it has the key and meets the gate."""
    other = gated.select(*keys, F.col(value).alias("__value"), gate.alias("__gate"))
    joined = base.join(other, keys, "left")
    use = F.coalesce("__gate", F.lit(False))
    return joined.withColumn("replaced", use).withColumn(value, F.when(use, F.col("__value")).otherwise(F.col(value))).drop("__value", "__gate")

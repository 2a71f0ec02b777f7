"""The shape of a sequence: the weighted median of many observed vectors, dimension by dimension,
over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.sources.scratch import cut

#: The least weight of an observation, and the bounds of a shape's entries.
LEAST, BOUND = 1e-3, 3.0
#: Rows of a group that one task may sort, and cells of a larger group's values.
BUFFER, CELLS = 100_000, 4096


def best_of(df: DataFrame, keys: list[str], score: str, most: int, ties: list[str]) -> DataFrame:
    """The `most` rows of each key by score, the greatest first, then `ties` in order. Rows are cut
    to `most` within hashed parts of a key first, so that no task sorts a whole group."""
    order = [F.desc(score), *[F.asc(t) for t in ties]]
    part = F.pmod(F.xxhash64(*keys, score, *ties), F.lit(64))
    for by in ([*keys, "__part"], keys):
        df = df.withColumn("__part", part).withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= most).drop("__rank", "__part")
    return df


def weighted_quantile(df: DataFrame, keys: list[str], vector: str, weight: str, share: float = 0.5, buffer: int = BUFFER) -> DataFrame:
    """(keys, count, `vector`): of each dimension the least value at which the running weight
    reaches `share` of the key's (vectors of one length a key; null vectors, entries and weights
    don't count).

    Weights are summed by distinct value. Where a group has more values than `buffer`, its range
    is cut into cells: sums of cells say in which one the quantile lies, and only that one's
    values are sorted. Both ways give the same values.
    """
    rows = df.select(*keys, F.posexplode(vector).alias("__d", "__v"), F.col(weight).cast("double").alias("__w")).where("__v is not null and __w is not null and not isnan(__v)")
    by = [*keys, "__d"]
    values = rows.groupBy(*by, "__v").agg(F.sum("__w").alias("__w"), F.count("*").alias("__n"))
    values = cut(values)  # read for the sums, the cells and the choice
    groups = values.groupBy(*by).agg(F.sum("__w").alias("__all"), F.sum("__n").alias("__of"), F.count("*").alias("__kinds"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    name = F.struct(*[F.struct(F.col(k).isNull(), F.col(k)).alias(f"k{i}") for i, k in enumerate(by)]).alias("__key")
    groups = cut(groups.select(name, "*"))
    large = F.col("__kinds") > buffer
    cell = F.when(large & (F.col("__high") > F.col("__low")), F.least(F.lit(CELLS - 1), F.floor((F.col("__v") - F.col("__low")) / (F.col("__high") - F.col("__low")) * CELLS))).otherwise(F.lit(0))
    celled = values.select(name, "__v", "__w").join(groups.select("__key", "__low", "__high", "__kinds", "__all"), "__key").select("__key", "__v", "__w", "__all", cell.cast("long").alias("__cell"))

    def first(sums: DataFrame, parts: list[str], order: str, before: Column) -> DataFrame:
        run = F.sum("__w").over(Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) + before
        # sums in another order round otherwise, which must not decide at the share itself
        reached = sums.withColumn("__run", run).where(F.col("__run") >= share * (1 - 1e-12) * F.col("__all"))
        return reached.groupBy(*parts).agg(F.min_by(F.struct(order, (F.col("__run") - F.col("__w")).alias("__before")), order).alias("__at"))

    cells = celled.groupBy("__key", "__cell").agg(F.sum("__w").alias("__w"), F.max("__all").alias("__all"), F.max("__v").alias("__top"))
    last = cells.groupBy("__key").agg(F.max("__cell").alias("__last"), F.max("__top").alias("__top"))
    chosen = last.join(first(cells, ["__key"], "__cell", F.lit(0.0)), "__key", "left").select("__key", "__top", F.coalesce("__at.__cell", "__last").alias("__cell"), F.coalesce("__at.__before", F.lit(0.0)).alias("__before"))
    inside = celled.join(chosen, ["__key", "__cell"])
    found = chosen.join(first(inside, ["__key"], "__v", F.col("__before")), "__key", "left").select("__key", F.coalesce("__at.__v", "__top").alias("__v"))
    each = groups.join(found, "__key").select(*by, "__of", "__v")
    return each.groupBy(*keys).agg(F.max("__of").alias("count"), F.transform(F.array_sort(F.collect_list(F.struct("__d", "__v"))), lambda x: x["__v"]).alias(vector))


def sequence_shape(df: DataFrame, keys: list[str], vector: str, score: str, most: int, ties: list[str], buffer: int = BUFFER) -> DataFrame:
    """(keys, count, `vector`): the shape of each sequence: of its `most` best observations by
    score the weighted median of every entry, weights LEAST at least, kept within BOUND. Rows
    without vector or score don't count; a key without any has no row (its shape is zeros)."""
    seen = df.where(F.col(vector).isNotNull() & F.col(score).isNotNull())
    kept = best_of(seen, keys, score, max(1, most), ties).withColumn("__w", F.greatest(F.col(score), F.lit(LEAST)))
    found = weighted_quantile(kept, keys, vector, "__w", 0.5, buffer)
    return found.withColumn(vector, F.transform(vector, lambda v: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), v))))

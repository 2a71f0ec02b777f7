"""Exact quantiles of groups of any size.

F.percentile keeps all distinct values of a group in one buffer, which is right while groups are
bounded. Where one has more than BUFFER values, each group's range is cut into cells, a first
aggregation counts the cells, and only the values of the cells in which the wanted ranks lie are
counted one by one: a task holds one cell, not one group. Both ways give the same quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.sources.scratch import cut

#: Cells of a group between its outer edges, and where these lie (the rest is in two cells more).
CELLS, EDGES = 4096, (0.001, 0.999)
#: Values of a group that one buffer may hold.
BUFFER = 1_000_000


def exact(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], buffer: int = BUFFER) -> DataFrame:
    """(keys, one column for each of `wanted`): linear quantiles of `value` by group, as of the
    sorted values at rank p * (n - 1). Nulls don't count; a group without values has no row.
    Null keys are groups. Reads df twice, or four times where a group is larger than `buffer`;
    the small tables between are cut."""
    values = df.select(*keys, F.col(value).cast("double").alias("q_v")).where("q_v is not null")
    largest = values.groupBy(*keys).agg(F.count("*").alias("q_n")).agg(F.max("q_n")).first()[0] or 0
    if largest <= buffer:
        every = values.groupBy(*keys).agg(F.percentile("q_v", F.array(*[F.lit(float(p)) for p in wanted.values()])).alias("q_p"))
        return every.where("q_p is not null").select(*keys, *[F.get("q_p", F.lit(i)).alias(n) for i, n in enumerate(wanted)])
    name = F.struct(*[F.struct(F.col(k).isNull(), F.col(k)).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.lit(0)
    v = values.withColumn("q_k", name)
    groups = cut(v.groupBy("q_k").agg(F.count("*").alias("q_n"), F.percentile_approx("q_v", list(EDGES), 1000).alias("q_e"), *[F.first(k).alias(k) for k in keys]))
    low, high = F.get("q_e", F.lit(0)), F.get("q_e", F.lit(1))
    cell = F.when(low < high, F.width_bucket("q_v", low, high, F.lit(CELLS))).otherwise(F.when(F.col("q_v") < low, 0).when(F.col("q_v") > low, 2).otherwise(1))
    celled = v.select("q_k", "q_v").join(groups.select("q_k", "q_e"), "q_k").select("q_k", "q_v", cell.cast("long").alias("q_c"))

    def before(w) -> Column:
        return F.coalesce(F.sum("q_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    counts = celled.groupBy("q_k", "q_c").agg(F.count("*").alias("q_m")).withColumn("q_b", before(Window.partitionBy("q_k").orderBy("q_c")))
    at = lambda p: F.lit(float(p)) * (F.col("q_n") - 1)
    # a wanted quantile lies at a fraction between two ranks
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(up).alias("up"), F.least(F.col("q_n") - 1, F.floor(at(p)) + up).alias("r")) for name, p in wanted.items() for up in (0, 1)])
    asked = groups.select("q_k", F.explode(ranks).alias("x")).select("q_k", "x.*")
    hit = (F.col("r") >= F.col("q_b")) & (F.col("r") < F.col("q_b") + F.col("q_m"))
    placed = cut(asked.join(counts, "q_k").where(hit).select("q_k", "q_c", "name", "up", (F.col("r") - F.col("q_b")).alias("q_at")))
    # equal values of a cell are one row
    inside = celled.join(placed.select("q_k", "q_c").distinct(), ["q_k", "q_c"]).groupBy("q_k", "q_c", "q_v").agg(F.count("*").alias("q_m"))
    inside = inside.withColumn("q_b", before(Window.partitionBy("q_k", "q_c").orderBy("q_v")))
    found = placed.join(inside, ["q_k", "q_c"]).where((F.col("q_at") >= F.col("q_b")) & (F.col("q_at") < F.col("q_b") + F.col("q_m")))
    wide = found.groupBy("q_k").agg(*[F.max(F.when((F.col("name") == n) & (F.col("up") == up), F.col("q_v"))).alias(f"q_{n}{up}") for n in wanted for up in (0, 1)])
    part = lambda p: at(p) - F.floor(at(p))
    blend = {n: F.col(f"q_{n}0") + part(p) * (F.col(f"q_{n}1") - F.col(f"q_{n}0")) for n, p in wanted.items()}
    return groups.join(wide, "q_k").select(*keys, *[c.alias(n) for n, c in blend.items()])

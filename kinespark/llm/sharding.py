"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in partitions (by a hash of their content and their number among equal rows). How many rows of each partition go to each
shard has, in a uniform shuffle with given shard sizes, a multivariate hypergeometric law with
the partitions' and the shards' sizes as margins. The matrix is drawn first, top down over a
tree of partition ranges; then each partition permutes its rows and deals them out by its row
of the matrix, the rows are exchanged, and each shard permutes what it got. DataFrame and SQL
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered_copies, row_keys, stored, unit

#: Rows of a partition on average, children of a node of the tree of partitions.
PARTITION_ROWS, FAN = 8192, 16
#: Standard deviations on either side of the mode that a draw covers; beyond lies less than
#: 1e-22 of the law, far below the rounding of a double.
REACH = 10.0


def hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """A draw of the number of good ones among `drawn` taken from `total` that hold `good`, by
    inversion of u in [0, 1): weights relative to that of the mode follow by recurrence to both
    sides, and u times their sum is used up along the values, first up from the mode, then down."""
    spec = F.struct(
        good.cast("double").alias("k"),
        total.cast("double").alias("n"),
        drawn.cast("double").alias("d"),
        u.alias("u"),
    )

    def with_range(s: Column) -> Column:
        mode = F.greatest(F.lit(0.0), F.least(F.least(s.k, s.d), F.floor((s.d + 1) * (s.k + 1) / (s.n + 2)).cast("double")))
        mode = F.greatest(mode, s.d - (s.n - s.k))
        spread = F.ceil(REACH * F.sqrt(s.d * (s.k / F.greatest(s.n, F.lit(1.0))) * ((s.n - s.k) / F.greatest(s.n, F.lit(1.0)))) + REACH)
        return F.struct(
            s.k.alias("k"), s.n.alias("n"), s.d.alias("d"), s.u.alias("u"), mode.alias("mode"),
            F.least(F.least(s.k, s.d), mode + spread).alias("high"),
            F.greatest(F.greatest(F.lit(0.0), s.d - (s.n - s.k)), mode - spread).alias("low"),
        )

    def let(value: Column, then) -> Column:
        return F.element_at(F.transform(F.array(value), then), 1)

    def ups(s: Column) -> Column:
        return F.when(s.high > s.mode, F.sequence(s.mode.cast("long"), s.high.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))

    def downs(s: Column) -> Column:
        return F.when(s.low < s.mode, F.sequence(s.mode.cast("long"), s.low.cast("long") + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def up(s: Column, x: Column) -> Column:
        return (s.k - x) * (s.d - x) / ((x + 1.0) * (s.n - s.k - s.d + x + 1.0))

    def down(s: Column, x: Column) -> Column:
        return x * (s.n - s.k - s.d + x) / ((s.k - x + 1.0) * (s.d - x + 1.0))

    def mass(s: Column, values: Column, ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

        def add(a: Column, x: Column) -> Column:
            w = a.w * ratio(s, x.cast("double"))
            return F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))

        return F.aggregate(values, start, add, lambda a: a["sum"])

    def walk(s: Column, values: Column, ratio, sign: int, state: Column) -> Column:
        """state: rest of u, result (-1: none yet), weight."""

        def step(a: Column, x: Column) -> Column:
            w = a.w * ratio(s, x.cast("double"))
            hit = (a.result < 0) & (a.rest < w)
            result = F.when(hit, x.cast("double") + float(sign)).otherwise(a.result)
            return F.struct((a.rest - w).alias("rest"), result.alias("result"), w.alias("w"))

        return F.aggregate(values, state, step)

    def drawn_value(s: Column) -> Column:
        whole = 1.0 + mass(s, ups(s), up) + mass(s, downs(s), down)
        return let(
            s.u * whole,
            lambda rest: F.when(rest < 1.0, s.mode).otherwise(
                let(
                    walk(s, ups(s), up, 1, F.struct((rest - 1.0).alias("rest"), F.lit(-1.0).alias("result"), F.lit(1.0).alias("w"))),
                    lambda a: F.when(a.result >= 0, a.result).otherwise(
                        let(
                            walk(s, downs(s), down, -1, F.struct(a.rest.alias("rest"), F.lit(-1.0).alias("result"), F.lit(1.0).alias("w"))),
                            lambda b: F.when(b.result >= 0, b.result).otherwise(s.low),
                        )
                    ),
                )
            ),
        )

    return let(spec, lambda s: let(with_range(s), drawn_value)).cast("long")


def communication_matrix(sizes: DataFrame, partitions: int, shards: int, total: int, seed: int = 0) -> DataFrame:
    """Rows (p, row) for the partitions 0 to partitions - 1 of `sizes` (p, n): how many of the
    n rows of partition p go to each shard. Shard sizes differ by one at most.

    A node of the tree stands for a range of partitions and has what the shards take from it;
    its children draw in turn, shard by shard, from what the ones before have left. Each level
    is one projection over its nodes."""
    depth = 0
    while FAN**depth < partitions:
        depth += 1
    spark = sizes.sparkSession
    even = [total // shards + (j < total % shards) for j in range(shards)]
    level = spark.range(1).select(F.col("id").alias("node"), F.array(*[F.lit(x).cast("long") for x in even]).alias("row"))
    for down in range(depth - 1, -1, -1):
        child = F.floor(F.col("p") / FAN**down)
        wide = sizes.groupBy(F.floor(child / FAN).alias("node"), (child % FAN).alias("c")).agg(F.sum("n").alias("n"))
        wide = wide.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "n"))).alias("children"))

        def give(state: Column, at: Column) -> Column:
            """state: row (left for the later children), made (rows of the children so far)."""

            def deal(s: Column, j: Column) -> Column:
                x = F.when(s.need == 0, F.lit(0).cast("long")).otherwise(
                    hypergeometric(F.element_at(state.row, j), s.left, s.need, unit(F.lit(seed), F.lit(down), F.col("node"), at.c, j))
                )
                return F.element_at(
                    F.transform(
                        F.array(x),
                        lambda v: F.struct((s.need - v).alias("need"), (s.left - F.element_at(state.row, j)).alias("left"), F.concat(s.got, F.array(v)).alias("got")),
                    ),
                    1,
                )

            left = F.aggregate(state.row, F.lit(0).cast("long"), lambda a, v: a + v)
            start = F.struct(at.n.alias("need"), left.alias("left"), F.array().cast("array<bigint>").alias("got"))
            got = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, deal, lambda s: s.got)
            return F.element_at(
                F.transform(
                    F.array(got),
                    lambda g: F.struct(
                        F.zip_with(state.row, g, lambda a, b: a - b).alias("row"),
                        F.concat(state.made, F.array(F.struct((F.col("node") * FAN + at.c).alias("node"), g.alias("row")))).alias("made"),
                    ),
                ),
                1,
            )

        nothing = F.array().cast("array<struct<node:bigint,row:array<bigint>>>")
        made = F.aggregate("children", F.struct(F.col("row").alias("row"), nothing.alias("made")), give, lambda s: s.made)
        level = cut(level.join(wide, "node").select(F.explode(made).alias("x")).select("x.node", "x.row"))
    return level.select(F.col("node").alias("p"), "row")


def shard(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of
    `docs`, in a uniformly random order dealt to `shards` shards whose counts differ by one at
    most (law `rows`); slots run from 0 without gaps. size is the text's UTF-8 bytes plus 16.

    A null text counts as empty: size 16 and checksum 0. Null ids take part; repeated rows keep
    a row each and go their own ways, however many they are. grown_shard is null: the law `rows` gives no promise on another shard count.
    The result depends on the rows and the seed alone, not on how they are stored. Other
    columns are ignored. No rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *row_keys("doc_id", "text"),
    )
    # a row's name is its content and its number among the rows equal to it, so all names differ
    named = stored(numbered_copies(sized).withColumn("name", F.xxhash64("k1", "k2", "copy")))
    total = named.count()
    partitions = max(1, -(-total // PARTITION_ROWS))
    salt = F.lit(seed)
    here = named.withColumn("p", F.pmod(F.xxhash64(salt, "name"), F.lit(partitions).cast("long")))
    counts = cut(here.groupBy("p").agg(F.count("*").alias("n")))
    matrix = communication_matrix(counts, partitions, shards, total, seed)
    # permute locally and deal out: the first row[0] rows go to shard 0, the next row[1] to 1 ...
    local = Window.partitionBy("p").orderBy(F.xxhash64(salt, F.lit(1), "name", "copy"), "name", "k1", "copy")
    ends = F.aggregate("row", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    dealt = (
        here.withColumn("rank", F.row_number().over(local))
        .join(matrix.select("p", ends.alias("ends")), "p")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    )
    # exchange and permute again, in runs of bounded size within a shard
    runs = 1
    while runs * PARTITION_ROWS * 4 < total // shards:
        runs *= 2
    again = F.xxhash64(salt, F.lit(2), "name", "copy")
    dealt = dealt.select("doc_id", "size", "text_crc32", "k1", "copy", "shard", again.alias("again"), F.shiftrightunsigned(again, 33).alias("run"))
    dealt = dealt.withColumn("run", F.floor(F.col("run") * runs / F.lit(float(1 << 31))))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "run").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("shard", "run").orderBy(F.shiftrightunsigned("again", 1), "k1", "copy")
    return dealt.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["shard", "run"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

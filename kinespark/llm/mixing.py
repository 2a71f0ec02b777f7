"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled and laid end to end, and the stream is cut into blocks of
`block_words` words, of which a source's last may be shorter. A source needs as many slots as
its target fills. A schedule maps the golden-ratio points frac((t + 1) / phi) through the
cumulative needs, so every stretch of slots has every source in nearly its share; the slots of a
source are ranked and its r-th slot takes its block r modulo its number of blocks, in epoch r div
that number. Its last slot brings only the words that its target still lacks; slots that the
points give it beyond its need are dropped, and those they leave it short of follow the schedule.
So every source's words are its target to the word, however small it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, n_words, row_keys, stored

#: 1 / golden ratio, the step of the schedule's points.
STEP = 0.6180339887498949
#: Words of a block, documents of a run of prefix sums, slots of a run of ranks.
BLOCK_WORDS, RUN, SLOTS = 64, 20_000, 65_536
#: Cells of [0, 1) in which points and the sources' bounds meet; a power of two, so exact.
CELLS = 4096
#: Sources up to which their table is broadcast; more are joined by shuffles.
FEW_SOURCES, SALTS = 100_000, 64


def _prefix(df: DataFrame, keys: list[str], run: str, order: list[Column], amount: str, name: str) -> DataFrame:
    """df with the sum of `amount` over the rows before each within `keys`, by run and then
    `order`. Sums by run come first, so that no task sees more than one run of rows."""
    runs = df.groupBy(*keys, run).agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    own = Window.partitionBy(*keys, run).orderBy(*order)
    return (
        df.withColumn("__own", F.coalesce(F.sum(amount).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("at", F.row_number().over(own))
        .join(runs, [*keys, run])
        .withColumn(name, F.col("__before") + F.col("__own"))
        .drop("__before", "__own")
    )


def _ordered(df: DataFrame, rows: int, order: list[Column]) -> DataFrame:
    """df, cut into ranges of the order of about RUN rows with their number as `run`."""
    ranged = cut(df.repartitionByRange(max(1, -(-rows // RUN)), *order))
    return ranged.withColumn("run", F.spark_partition_id())


def _targets(sized: DataFrame, weights: tuple[float, ...], most: float, block_words: int) -> tuple[DataFrame, int]:
    """(one row a source, their number): its size, its target in words, its blocks, the slots it
    needs and its bounds in the schedule. Sources by code point, null last, weigh `weights` in
    turn; a target stops at `most` times the source's size and the excess is shared by weight
    among the rest until none is above. Orders and sums go by ranges, so no task sees all
    sources."""
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = sources.count()
    by_name = [F.col("source").asc_nulls_last()]
    numbered = _prefix(_ordered(sources, n, by_name).withColumn("one", F.lit(1)), [], "run", by_name, "one", "id").drop("one", "at", "run")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("id") % len(weights) + 1).cast("int"))
    table = numbered.withColumn("weight", weight).withColumn("id", F.col("id") + 1).withColumn("cap", F.col("source_size") * float(most))
    # The level rises until the sources with the least cap for their weight are full. In that
    # order each source sees what the full ones before it leave and who shares it.
    rising = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    ranged = cut(_ordered(table, n, rising))
    before = _prefix(ranged, [], "run", rising, "cap", "caps").drop("at")
    before = cut(_prefix(before, [], "run", rising, "weight", "weights").drop("at", "run"))
    every = before.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    level = (F.lit(float(every.s or 0)) - F.col("caps")) / (F.lit(float(every.w or 0)) - F.col("weights"))
    leveled = before.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    first = leveled.where("not full").agg(F.min(F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))["level"]).first()[0]
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.lit(first).cast("double") * F.col("weight"))
    filled = leveled.withColumn("target", target).withColumn("words", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    whole, part = F.floor(F.col("words") / F.col("source_size")), F.ceil(F.pmod("words", "source_size") / block_words)
    needed = filled.withColumn("slots", F.when(F.col("source_size") > 0, whole * F.col("blocks") + part).otherwise(F.lit(0)).cast("long"))
    bounds = cut(_prefix(_ordered(needed, n, by_name), [], "run", by_name, "slots", "first").drop("at", "run"))
    total = bounds.agg(F.sum("slots")).first()[0] or 0
    low, high = (F.col(c) / F.lit(float(max(total, 1))) for c in ("first", "last"))
    bounds = bounds.withColumn("last", F.col("first") + F.col("slots")).withColumn("low", low).withColumn("high", F.when(F.col("last") == total, 2.0).otherwise(high))
    return bounds.select("id", "source", "source_size", "target", "words", "blocks", "slots", "low", "high"), n


def _with_sources(sized: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """sized with its sources' rows; a hot source is dealt over SALTS tasks where the table is
    too large to broadcast."""
    names = table.select("id", F.col("source").alias("s"), "source_size", "target")
    if n <= FEW_SOURCES:
        return sized.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    salted = sized.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int"))
    names = names.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(names, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("t"))).drop("s", "salt", "t")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, block_words: int = BLOCK_WORDS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pieces, slots): the documents cut by block, and the schedule.

    pieces: doc_id, k1 and k2 (of the row's content), size, source_size, target, id (of its source),
    run and at (its place in the source), block, offset (in the block), words. slots: slot, id,
    rank, block, epoch, room (words that the source may still take there: a slot brings the words
    of its block up to it). A document's word belongs to one block; a block comes in once for each
    of its slots, at most `most` times. A source takes round(target) words, whether it is smaller
    than a block or no multiple of one; slots that follow the schedule share the number after its
    last. A document without words has one piece with block null. A null source is a source of
    its own; the other columns don't matter. Sources may be as many as documents. Equal tables
    give equal mixes: the shuffle orders rows by a digest of the seed and doc_id, then by id,
    size and content.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest.alias("digest"), *row_keys("doc_id", "source", "text")))
    table, n = _targets(sized, weights, most, block_words)
    rows = sized.count()
    hexes = 1
    while 16**hexes * RUN < rows:
        hexes += 1
    known = _with_sources(sized, table, n).withColumn("run", F.substring("digest", 1, hexes))
    placed = _prefix(known, ["id"], "run", [F.col("digest"), F.col("doc_id"), F.col("size"), F.col("k1"), F.col("k2")], "size", "start")
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    span = F.when(F.col("size") > 0, F.sequence(first, last))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    held = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - low
    pieces = placed.withColumn("block", F.explode_outer(span)).withColumn("offset", low - F.col("block") * block_words).withColumn("words", F.coalesce(held, F.lit(0)).cast("long"))

    n_slots = table.agg(F.sum("slots")).first()[0] or 0
    cells = CELLS
    while cells < 4 * n:
        cells *= 2
    point = (F.col("slot") + 1).cast("double") * STEP
    points = docs.sparkSession.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * cells))
    bounds = table.where("slots > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.lit(cells - 1), F.floor(F.col("high") * cells))))).select("id", "low", "high", "cell")
    here = (points.cell == bounds.cell) & (points.u >= bounds.low) & (points.u < bounds.high)
    # with few sources some 2 * FEW_SOURCES + CELLS small rows are broadcast; else a cell holds a few
    given = points.join(F.broadcast(bounds) if n <= FEW_SOURCES else bounds, here).select("slot", "id", F.floor(F.col("slot") / SLOTS).alias("run"), F.lit(1).alias("one"))
    ranked = _prefix(given, ["id"], "run", [F.col("slot")], "one", "rank").select("slot", "id", "rank")
    needs = table.select("id", "source_size", "words", "blocks", "slots")
    had = ranked.groupBy("id").agg(F.count("*").alias("had"))
    short = needs.join(had, "id", "left").where(F.col("slots") > F.coalesce("had", F.lit(0)))
    after = short.select(F.lit(n_slots).cast("long").alias("slot"), "id", F.explode(F.sequence(F.coalesce("had", F.lit(0)), F.col("slots") - 1)).alias("rank"))
    needs = F.broadcast(needs) if n <= FEW_SOURCES else needs
    every = ranked.unionByName(after).join(needs, "id").where("rank < slots")
    every = every.withColumn("block", F.pmod("rank", "blocks")).withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")))
    room = F.col("words") - F.col("epoch") * F.col("source_size") - F.col("block") * block_words
    schedule = every.select("slot", "id", "rank", "block", "epoch", room.alias("room"))
    return pieces.select("doc_id", "k1", "k2", "size", "source_size", "target", "id", "run", "at", "block", "offset", "words"), schedule


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Rows (doc_id, k1, k2, size, source_size, target, taken), one for each row of `docs`: how
    many of its words the mix takes, repeats counted. k1 and k2 are hashes of doc_id, source and
    text. See mix() for nulls, ties and repeats."""
    pieces, slots = mix(docs, **how)
    times = slots.groupBy("id", "block").agg(F.count("*").alias("times"), F.min("room").alias("room"))
    # of a block's slots only the last can be short of room
    final = F.greatest(F.lit(0), F.least(F.col("words"), F.col("room") - F.col("offset")))
    took = F.col("words") * (F.col("times") - 1) + final
    joined = pieces.join(times, ["id", "block"], "left").withColumn("took", F.coalesce(took, F.lit(0)))
    by = ["doc_id", "k1", "k2", "size", "source_size", "target", "id", "run", "at"]
    return joined.groupBy(*by).agg(F.sum("took").alias("taken")).drop("id", "run", "at")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: each row of `docs` as often as the mix takes all its words, and
    the one document of a source at which the schedule ends with its first words, single
    spaces between them. Documents that the mix doesn't take, or without words, are left out.
    Rows alike in doc_id, source and text come as often as the mix takes them together; rows
    that differ in any of these, nulls included, are documents of their own. All columns are
    returned as they came; n_chars, where there is one, follows a cut text. The rows of a table
    have no order, so the order of the schedule's slots isn't kept: it decides what is taken.
    A training run's order comes from sharding the packed bins."""
    keys = ["__k1", "__k2"]
    taken = mixed(docs, **how).groupBy("k1", "k2").agg(F.sum("taken").alias("__taken"), F.max("size").alias("__size")).where("__taken > 0")
    named = docs.withColumns(dict(zip(keys, row_keys("doc_id", "source", "text"), strict=True)))
    here = named.dropDuplicates(keys).join(taken.withColumnsRenamed({"k1": "__k1", "k2": "__k2"}), keys)
    rest = (F.col("__taken") % F.col("__size")).cast("int")
    copies = here.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("__taken") / F.col("__size")))))
    is_cut = (rest > 0) & (F.col("__copy") * F.col("__size") > F.col("__taken"))
    short = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, rest), " ")
    copies = copies.withColumn("__text", F.when(is_cut, short).otherwise(F.col("text")))
    out = {"text": F.col("__text"), "n_chars": F.when(is_cut, F.char_length("__text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return copies.select(*[out[c].alias(c) if out.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])

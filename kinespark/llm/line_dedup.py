"""Removal of lines that many sites share. DataFrame and SQL functions only.

Every line is hashed after white space is evened out. A HyperLogLog sketch of the sites of each
hash, merged by aggregation, says on about how many sites the line stands. Lines far from the
threshold are decided by the sketch; those near it get an exact distinct count of their sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_keys, stored

#: Estimates within this share of the threshold are counted exactly. Sketches of 2 ** 12
#: registers have a standard error of 1.6 %, so this is fifteen standard errors.
NEAR = 0.25


def _flagged(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h, first): hashes of lines on at least min_sites sites, and where each stands first."""
    spread = stored(
        lines.groupBy("h")
        .agg(F.hll_sketch_agg("site", 12).alias("sketch"), F.min(F.struct("doc_id", "k1", "k2", "pos")).alias("first"))
        .select("h", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - NEAR))
    )
    near = spread.where(F.col("sites") <= min_sites * (1 + NEAR))
    exact = lines.join(near.select("h"), "h", "left_semi").groupBy("h").agg(F.countDistinct("site").alias("exact"))
    sure = spread.where(F.col("sites") > min_sites * (1 + NEAR)).select("h", "first")
    return sure.unionByName(near.join(exact.where(F.col("exact") >= min_sites), "h").select("h", "first"))


def line_dedup(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """`docs` with two more columns, n_lines and n_removed (long), and `text` without the lines
    that stand on at least `min_sites` sites (distinct sources), but for the first place of
    each: that with the smallest doc_id, then row hash, then position.

    Lines are parted by \\n; they are alike if they agree after runs of white space become one
    space and those at the ends go. Blank lines never count and always stay. Null text stays
    null with no lines. A null source is a site of its own. Rows alike in doc_id, source and
    text share one fate, the first place included. n_chars, where there is one, follows a
    changed text. Other columns are returned as they came; n_lines and n_removed replace
    columns of these names.
    """
    keyed = docs.select("doc_id", "source", "text", *row_keys("doc_id", "source", "text"))
    even = F.trim(F.regexp_replace("line", r"[\x20\x09-\x0D]+", " "))
    lines = stored(
        keyed.select("doc_id", "source", "k1", "k2", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("even", even)
        .where("even <> ''")
        .select(
            "doc_id", "k1", "k2", "pos",
            F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit(""))).alias("site"),
            F.xxhash64("even").alias("h"),
        )
    )
    place = F.struct("k1", "k2", "pos")
    gone = (
        lines.join(_flagged(lines, min_sites), "h")
        .where(place != F.struct("first.k1", "first.k2", "first.pos"))
        .groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
        .agg(F.collect_set("pos").alias("__gone"))
    )
    keys = dict(zip(("__k1", "__k2"), row_keys("doc_id", "source", "text"), strict=True))
    joined = docs.withColumns(keys).join(gone, ["__k1", "__k2"], "left")
    split = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "__gone")
    whole = joined.withColumn("__lines", split).withColumn("__text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")))
    out = {
        "text": F.col("__text"),
        "n_lines": F.coalesce(F.size("__lines"), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
    }
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.char_length("__text").cast("long"))
    names = [*docs.columns, *(c for c in ("n_lines", "n_removed") if c not in docs.columns)]
    return whole.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in names])

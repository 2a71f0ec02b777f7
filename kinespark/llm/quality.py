"""Quality rules with cross-document line frequency. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, row_keys, stored, words

#: Words of a window whose repetition within a text counts.
WINDOW = 5


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def repeated_words(found: Column) -> Column:
    """Words of an array that lie in windows of WINDOW words found twice or more in it. Windows
    are told apart by 64-bit hashes. Starts of repeated windows, in order, cover the distance
    to the next start, WINDOW words at most, so the cost is that of sorting."""
    starts = F.when(F.size(found) >= WINDOW, F.sequence(F.lit(0), F.size(found) - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(found, i + j) for j in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return _let(pairs, lambda s: _let(F.sort_array(F.transform(F.filter(s, lambda e, i: same(s, e, i - 1) | same(s, e, i + 1)), lambda e: e.i)), length))

    def same(s: Column, e: Column, i: Column) -> Column:
        return F.coalesce((i >= 0) & (F.get(s, i).x == e.x), F.lit(False))

    def length(p: Column) -> Column:
        steps = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, v: a + v)

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def text_rules(docs: DataFrame, min_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """(k1, k2, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed) for each row, from its text alone. Null text has none of anything."""
    # stop at the text, so that each of its pieces is made once
    parts = docs.select("doc_id", *row_keys("doc_id", "source", "text"), "text").select(
        "doc_id", "k1", "k2", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines")
    )
    zero = F.lit(0)
    measured = parts.select(
        "k1",
        "k2",
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.char_length("text") - F.char_length(F.regexp_replace("text", r"[#*$%&|<>]", "")), zero).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), zero).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def removed_words(docs: DataFrame, min_docs: int, percent: int) -> DataFrame:
    """(k1, k2, removed): words of the lines that a document loses because more than `min_docs`
    documents of its host (source), and more than `percent` percent of those with any line, have them. The
    first document of the host (by doc_id, then row hash) keeps such a line, so nothing vanishes
    altogether."""
    even = F.trim(F.regexp_replace(F.regexp_replace("line", r"[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))
    host = F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))
    keyed = docs.select("doc_id", *row_keys("doc_id", "source", "text"), host.alias("host"), "text")
    lines = stored(
        keyed.select("doc_id", "k1", "k2", "host", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("even", even)
        .where("even <> ''")
        .select("doc_id", "k1", "k2", "pos", "host", F.xxhash64("even").alias("h"), n_words(F.col("line")).alias("n"))
    )
    hosts = lines.groupBy("host", "k1", "k2").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    per_doc = lines.groupBy("host", "h", "doc_id", "k1", "k2").agg(F.count("*").alias("n"))
    often = per_doc.groupBy("host", "h").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "k1")).alias("first")).where(F.col("docs") > min_docs)
    common = often.join(hosts, "host").where(100 * F.col("docs") > percent * F.col("host_docs")).select("host", "h", "first")
    gone = lines.join(common, ["host", "h"]).where(F.col("k1") != F.col("first.k1"))
    once = gone.groupBy("k1", "k2", "pos").agg(F.max("n").alias("n"))  # rows that repeat a document are one
    return once.groupBy("k1", "k2").agg(F.sum("n").alias("removed"))


def quality(docs: DataFrame, min_docs: int = 5, percent: int = 10, min_left: int = 10, least_share: int = 20) -> DataFrame:
    """text_rules() with `removed` (long) and `kept`: false if base_failed, or if the lines that
    more than `min_docs` documents and `percent` percent of the documents of the host share leave
    fewer than `min_left` words or less than `least_share` percent of the words. One row for each
    row of `docs`.

    Lines are compared with numbers as 0 and white space evened out; blank ones don't count. A
    null source is a host of its own. A null or empty text has no words, so base_failed holds.
    Rows alike in doc_id, source and text are one document. Other columns are ignored.
    """
    gone = removed_words(docs, min_docs, percent)
    joined = text_rules(docs).join(gone, ["k1", "k2"], "left").withColumn("removed", F.coalesce("removed", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("removed")
    depleted = (F.col("removed") > 0) & ((left < min_left) | (100 * left < least_share * F.col("n_words")))
    return joined.withColumn("kept", ~F.col("base_failed") & ~depleted)


def drop_low_quality(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that quality() keeps, all columns as they came."""
    bad = quality(docs, **how).where("not kept").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    keys = dict(zip(("__k1", "__k2"), row_keys("doc_id", "source", "text"), strict=True))
    return docs.withColumns(keys).join(bad, ["__k1", "__k2"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

"""Labels of hands: which source counts, what an unknown one takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sources whose `is_right` is trusted.
TRUSTED = ("manual", "prompt", "prompt_cluster")


def is_side(label: Column) -> Column:
    return F.coalesce(label.isin("Left", "Right"), F.lit(False))


def opposite(label: Column) -> Column:
    return F.when(label == "Left", "Right").when(label == "Right", "Left").otherwise("unknown")


def is_right(label: Column) -> Column:
    return F.when(label == "Right", 1).when(label == "Left", 0)


def best_label(locked: Column, label: Column, source: Column, right: Column, confidence: Column, score: Column) -> Column:
    """struct(label, source, confidence) of a tracked detection: its locked label, else its own,
    else that of `right` (0 or 1) where its source is trusted; all null else. An empty source
    counts as none."""
    named = F.nullif(source, F.lit(""))
    trusted = F.coalesce(source.isin(*TRUSTED) & right.isin(0, 1), F.lit(False))
    entry = lambda a, b, c: F.struct(a.alias("label"), b.alias("source"), c.cast("double").alias("confidence"))
    null = F.lit(None).cast("string")
    return (
        F.when(is_side(locked), entry(locked, F.coalesce(named, F.lit("sam3_track_locked")), confidence))
        .when(is_side(label), entry(label, F.coalesce(named, F.lit("sam3")), confidence))
        .when(trusted, entry(F.when(right == 1, "Right").otherwise("Left"), source, F.coalesce(confidence, score)))
        .otherwise(entry(null, null, F.lit(None)))
    )


def takes_prior(label: Column, source: Column) -> Column:
    """Whether a camera's usual side applies: only to a row whose side is unknown."""
    return ~is_side(label) | F.coalesce(source.startswith("sam3_only_unknown"), F.lit(False))

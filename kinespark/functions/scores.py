"""Quality of a predicted view as a weighted sum of what speaks for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V

#: Weights of the mask, area and edge scores, bonuses of the detectors and of a
#: known label, the mask's score where there is none, and the cost of a scale other than 1.
MASK, AREA, EDGE, DETECTORS, KNOWN = 0.55, 0.15, 0.12, 0.06, 0.05
NO_MASK, SCALE_COST = 0.28, 0.04


def quality(mask: Column, fallback: Column, blurred: Column, box: Column, origin: Column, known: Column, scale: Column, width: float, height: float) -> Column:
    """mask: its score, else the detector's, else 0 if blurred, else NO_MASK."""
    seen = F.when(mask.isNotNull(), V.clamp01(mask)).when(fallback.isNotNull(), V.clamp01(fallback)).when(F.coalesce(blurred, F.lit(False)), 0.0).otherwise(NO_MASK)
    share = F.when(origin == "mediapipe+sam3", 1.0).when(origin.isin("mediapipe", "sam3"), 0.5).otherwise(0.0)
    boxed = lambda score: F.when(F.size(F.coalesce(box, F.array().cast("array<double>"))) == 4, score).otherwise(0.0)
    return (
        MASK * seen
        + AREA * boxed(V.area_score(box, width, height))
        + EDGE * boxed(V.edge_score(box, width, height))
        + DETECTORS * share
        + F.when(F.coalesce(known, F.lit(False)), KNOWN).otherwise(0.0)
        - SCALE_COST * F.abs(F.coalesce(scale, F.lit(1.0)) - 1.0)
    )


#: Confidence of a joint by the scores of its box's area and edge and of its mask.
BASE, BY_AREA, BY_EDGE, BY_MASK, UNKNOWN_MASK, OFF_MASK = 0.20, 0.35, 0.20, 0.25, 0.35, 0.45


def joint_confidence(pixel: Column, box: Column, mask: Column, on_mask: Column, width: float, height: float) -> Column:
    """0 outside the image; else by the box and the mask's score (null: UNKNOWN_MASK), less
    for a joint off the mask. on_mask: null where there is no mask."""
    base = BASE + BY_AREA * V.area_score(box, width, height) + BY_EDGE * V.edge_score(box, width, height) + BY_MASK * V.clamp01(F.coalesce(mask, F.lit(UNKNOWN_MASK)))
    inside = (V.at(pixel, 0) >= 0) & (V.at(pixel, 0) < width) & (V.at(pixel, 1) >= 0) & (V.at(pixel, 1) < height)
    return F.when(inside, V.clamp01(base * F.when(F.coalesce(on_mask, F.lit(True)), 1.0).otherwise(OFF_MASK))).otherwise(0.0)


def overlap_score(shared: Column, reference: Column, candidate: Column) -> Column:
    """Areas of two masks and of what they share: .45 overlap, .45 of the reference covered,
    .10 of the candidate covered."""

    def part(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return 0.45 * part(shared, reference + candidate - shared) + 0.45 * part(shared, reference) + 0.10 * part(shared, candidate)


def role(camera: Column, primary: str, backup: str | None) -> Column:
    return F.when(camera == primary, "primary").when(camera == F.lit(backup), "backup_primary").otherwise("quality_anchor")


def consensus(error: Column, cap: float, weight: float) -> Column:
    """weight for views that agree, falling to 0 at an error of cap; 0 for null."""
    return F.coalesce(weight * F.greatest(F.lit(0.0), 1.0 - F.least(error, F.lit(cap)) / cap), F.lit(0.0))


def backup_reason(known: Column, mask: Column, view: Column, error: Column, least_mask: float, least_view: float, most_error: float) -> Column:
    """Why a backup view is refused or taken: the first rule that holds."""
    seen = F.coalesce(mask, F.lit(0.0))
    return (
        F.when(known.isNull(), "missing_candidate")
        .when(~known, "not_known_hypothesis")
        .when((seen < least_mask) & (F.coalesce(view, F.lit(0.0)) < least_view), "low_mask_score")
        .when(F.coalesce(error > most_error, F.lit(False)), "temporal_discontinuity")
        .when(seen >= least_mask, "passed")
        .otherwise("passed_by_view_quality")
    )

"""Pixel sets as a column: an ascending array of runs (start, stop) of pixel numbers row by row,
stop not included, that neither meet nor overlap. All of it is built-in array functions, so masks
are compared where they are, in generated code, and never become images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V

KIND = "array<struct<start:bigint,stop:bigint>>"


def _run(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))


def joined(runs: Column) -> Column:
    """Any runs as a mask: sorted, empty ones left out, those that touch or overlap made one."""

    def add(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(_run(last["start"], F.greatest(last["stop"], r["stop"]))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["stop"] >= r["start"]), grown).otherwise(F.concat(out, F.array(r)))

    good = F.array_sort(F.filter(runs, lambda r: r["stop"] > r["start"]))
    return F.aggregate(good, F.array().cast(KIND), add)


def of_box(box: Column, width: int, height: int) -> Column:
    """The pixels whose centre lies in a box, within the image; null for a null box."""

    def side(low: Column, high: Column, most: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil(low - 0.5)).cast("long")
        return F.struct(first.alias("a"), F.least(F.lit(most), F.ceil(high - 0.5)).cast("long").alias("b"))

    def runs(s: Column) -> Column:
        rows = F.when(s["y"]["b"] > s["y"]["a"], F.sequence(s["y"]["a"], s["y"]["b"] - 1)).otherwise(F.array().cast("array<bigint>"))
        return joined(F.transform(rows, lambda y: _run(y * width + s["x"]["a"], y * width + F.greatest(s["x"]["a"], s["x"]["b"]))))

    sides = F.struct(side(V.at(box, 0), V.at(box, 2), width).alias("x"), side(V.at(box, 1), V.at(box, 3), height).alias("y"))
    return F.when(box.isNotNull(), V.let(sides, runs))


def of_hull(points: Column, width: int, height: int) -> Column:
    """The pixels whose centre lies in the convex hull of points (arrays x, y; at least three), row
    by row: a row meets the hull between the least and the greatest x of all segments there."""
    y_of = lambda p: V.at(p, 1)

    def row(y: Column) -> Column:
        centre = y + 0.5
        pairs = F.flatten(F.transform(points, lambda p: F.transform(F.filter(points, lambda q: (y_of(p) <= centre) & (y_of(q) >= centre)), lambda q: F.when(y_of(q) == y_of(p), V.at(p, 0)).otherwise(
            V.at(p, 0) + (V.at(q, 0) - V.at(p, 0)) * (centre - y_of(p)) / (y_of(q) - y_of(p))))))
        first = F.greatest(F.lit(0), F.ceil(F.array_min(pairs) - 0.5)).cast("long")
        last = F.least(F.lit(width), F.floor(F.array_max(pairs) - 0.5).cast("long") + 1)
        return F.when((F.size(pairs) > 0) & (last > first), _run(y * width + first, y * width + last))

    low = F.greatest(F.lit(0), F.ceil(F.array_min(F.transform(points, y_of)) - 0.5)).cast("long")
    high = F.least(F.lit(height - 1), F.floor(F.array_max(F.transform(points, y_of)) - 0.5)).cast("long")
    rows = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(points) >= 3, joined(F.filter(F.transform(rows, row), lambda r: r.isNotNull())))


def area(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda s, r: s + r["stop"] - r["start"])


def shared(a: Column, b: Column) -> Column:
    """Number of pixels in both. Of two masks' run ends in one order, each stretch between two
    neighbours is in both where two runs are open: one pass over a merge, not all pairs."""
    ends = lambda m: F.flatten(F.transform(m, lambda r: F.array(F.struct(r["start"].alias("at"), F.lit(1).alias("d")), F.struct(r["stop"].alias("at"), F.lit(-1).alias("d")))))
    every = F.array_sort(F.concat(ends(a), ends(b)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("open"), F.lit(0).cast("long").alias("n"))
    step = lambda s, e: F.struct(e["at"].alias("at"), (s["open"] + e["d"]).alias("open"), (s["n"] + F.when(s["open"] == 2, e["at"] - s["at"]).otherwise(F.lit(0))).alias("n"))
    return F.aggregate(every, start, step, lambda s: s["n"])


def scores(reference: Column, candidate: Column) -> Column:
    """(iou, reference_coverage, candidate_coverage, score) of two masks."""

    def made(s: Column) -> Column:
        both, union = s["i"], s["a"] + s["b"] - s["i"]
        part = lambda whole: F.when(whole > 0, both / whole).otherwise(F.lit(0.0))
        iou, ref, cand = part(union), part(s["a"]), part(s["b"])
        return F.struct(iou.alias("iou"), ref.alias("reference_coverage"), cand.alias("candidate_coverage"), (0.45 * iou + 0.45 * ref + 0.10 * cand).alias("score"))

    return V.let(F.struct(shared(reference, candidate).alias("i"), area(reference).alias("a"), area(candidate).alias("b")), made)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller mask that both have; 0 with a null or an empty one."""
    least = F.least(area(a), area(b))
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull() & (least > 0), shared(a, b) / least), F.lit(0.0))


def box(mask: Column, width: int) -> Column:
    """[x1, y1, x2, y2] of the outermost pixels; null for an empty mask. A run over the end of a
    row has pixels in its first and last column."""
    over = lambda r: F.floor(r["start"] / width) < F.floor((r["stop"] - 1) / width)
    low = F.array_min(F.transform(mask, lambda r: F.when(over(r), 0).otherwise(r["start"] % width)))
    high = F.array_max(F.transform(mask, lambda r: F.when(over(r), width - 1).otherwise((r["stop"] - 1) % width)))
    top, bottom = F.floor(F.element_at(mask, 1)["start"] / width), F.floor((F.element_at(mask, -1)["stop"] - 1) / width)
    return F.when(F.size(mask) > 0, F.array(*[c.cast("double") for c in (low, top, high, bottom)]))


def _pixel(p: Column, width: int, height: int) -> Column:
    near = lambda v, most: F.least(F.lit(most - 1), F.greatest(F.lit(0), F.bround(v))).cast("long")
    return near(V.at(p, 1), height) * width + near(V.at(p, 0), width)


def _in_image(p: Column, width: int, height: int) -> Column:
    return (V.at(p, 0) >= 0) & (V.at(p, 0) < width) & (V.at(p, 1) >= 0) & (V.at(p, 1) < height)


def share_inside(mask: Column, points: Column, width: int, height: int) -> Column:
    """Share of the points in the image whose pixel is in the mask; 0 without one in the image,
    null for a null mask."""
    own = F.filter(points, lambda p: _in_image(p, width, height))
    hits = F.filter(own, lambda p: F.exists(mask, lambda r: (r["start"] <= _pixel(p, width, height)) & (_pixel(p, width, height) < r["stop"])))
    return F.when(mask.isNotNull(), F.when(F.size(own) > 0, F.size(hits) / F.size(own)).otherwise(0.0))


def mean_distance(mask: Column, points: Column, width: int, height: int) -> Column:
    """Mean distance of the points' pixels from the mask's nearest pixel; a quarter of the image's
    longer side for a point outside it. Null for a null or empty mask, or without points. Runs
    must lie within a row, as those of of_box() and of_hull() under the image's width do."""

    def away(p: Column) -> Column:
        x, y = F.floor(_pixel(p, width, height) % width), F.floor(_pixel(p, width, height) / width)

        def to(r: Column) -> Column:
            a, b = r["start"] % width, (r["stop"] - 1) % width
            return F.hypot(F.greatest(F.lit(0), a - x, x - b).cast("double"), (F.floor(r["start"] / width) - y).cast("double"))

        return F.when(_in_image(p, width, height), F.array_min(F.transform(mask, to))).otherwise(max(width, height) * 0.25)

    total = F.aggregate(F.transform(points, away), F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(mask) > 0) & (F.size(points) > 0), total / F.size(points))


def with_rows(mask: Column, width: int) -> Column:
    """The mask with every run cut at the ends of rows."""

    def rows(r: Column) -> Column:
        every = F.sequence(F.floor(r["start"] / width), F.floor((r["stop"] - 1) / width))
        return F.transform(every, lambda y: _run(F.greatest(r["start"], y * width), F.least(r["stop"], (y + 1) * width)))

    return F.flatten(F.transform(mask, rows))

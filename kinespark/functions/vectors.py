"""Vectors of doubles as array columns, and boxes as four-element arrays; plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def vec(*parts: Column) -> Column:
    return F.array(*parts)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return at(a, 0) * at(b, 0) + at(a, 1) * at(b, 1) + at(a, 2) * at(b, 2)


def norm(a: Column) -> Column:
    """Length of a vector, which is computed once however long its expression is."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cross(a: Column, b: Column) -> Column:
    return vec(
        at(a, 1) * at(b, 2) - at(a, 2) * at(b, 1),
        at(a, 2) * at(b, 0) - at(a, 0) * at(b, 2),
        at(a, 0) * at(b, 1) - at(a, 1) * at(b, 0),
    )


def scaled(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def finite(v: Column) -> Column:
    """True if every component is a finite number; false for null."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), at(b, 2) - at(b, 0)) * F.greatest(F.lit(0.0), at(b, 3) - at(b, 1))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0))
    h = F.least(at(a, 3), at(b, 3)) - F.greatest(at(a, 1), at(b, 1))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 where that is empty."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def union_box(a: Column, b: Column) -> Column:
    return vec(F.least(at(a, 0), at(b, 0)), F.least(at(a, 1), at(b, 1)), F.greatest(at(a, 2), at(b, 2)), F.greatest(at(a, 3), at(b, 3)))


def clamp_box(b: Column, width: float, height: float) -> Column:
    """The box within the pixels 0 to width - 1 and height - 1, its corners in order."""

    def clip(x: Column, top: float) -> Column:
        return F.least(F.lit(float(top)), F.greatest(F.lit(0.0), x))

    x1, x2, y1, y2 = clip(at(b, 0), width - 1), clip(at(b, 2), width - 1), clip(at(b, 1), height - 1), clip(at(b, 3), height - 1)
    return vec(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def area_score(b: Column, width: float, height: float) -> Column:
    """Share of the image that the box takes: a ramp up to .003, 1 up to .12, then inverse; 0
    without a box."""
    share = area(b) / F.lit(float(width * height))
    return F.when(F.coalesce(share, F.lit(0.0)) <= 0, 0.0).when(share < 0.003, share / 0.003).when(share <= 0.12, 1.0).otherwise(0.12 / share)


def edge_score(b: Column, width: float, height: float) -> Column:
    """Distance of the box from the image's edge, 20 pixels beyond counting 0 and 60 within 1; 0
    without a box."""
    margin = F.least(at(b, 0), at(b, 1), F.lit(float(width)) - at(b, 2), F.lit(float(height)) - at(b, 3))
    return F.coalesce(F.when(F.size(b) == 4, clamp01((margin + 20.0) / 80.0)), F.lit(0.0))


def robust_weight(v: Column, scale: float) -> Column:
    """Cauchy weight 1 / (1 + (v / scale)^2), values below 0 as 0; 1 for null, 0 for what isn't
    finite."""
    fine = ~F.isnan(v) & (F.abs(v) < float("inf"))
    part = F.greatest(v, F.lit(0.0)) / max(float(scale), 1e-8)
    return F.when(v.isNull(), 1.0).when(fine, 1.0 / (1.0 + part * part)).otherwise(0.0)


def cauchy_loss(v: Column, scale: float) -> Column:
    return F.log1p((v / scale) * (v / scale))


def let(value: Column, then) -> Column:
    """then(value), with value computed once a row however often `then` uses it."""
    return at(F.transform(F.array(value), then), 0)


def palm_axes(joints: Column) -> Column:
    """Rows x, y, z of the palm frame: x from the wrist to the index base, z normal to it and
    the little finger's base, y = z cross x; null where the way to the index base, or the normal
    with x at length 1, is at most 1e-6 long. joints: array of points with wrist 0, index base 5,
    little finger base 17."""

    def axes(s: Column) -> Column:
        return let(
            F.when(norm(s.x) > 1e-6, F.struct(scaled(s.x, 1 / norm(s.x)).alias("x"), s.p.alias("p"))),
            lambda t: let(
                F.struct(t.x.alias("x"), cross(t.x, t.p).alias("z")),
                lambda u: F.when(norm(u.z) > 1e-6, let(F.struct(u.x.alias("x"), scaled(u.z, 1 / norm(u.z)).alias("z")), lambda v: F.array(v.x, cross(v.z, v.x), v.z))),
            ),
        )

    return let(F.struct(sub(at(joints, 5), at(joints, 0)).alias("x"), sub(at(joints, 17), at(joints, 0)).alias("p")), axes)


def palm_local(joints: Column) -> Column:
    """Every point in the palm frame, from the wrist; null where the frame is degenerate."""

    def moved(s: Column) -> Column:
        return F.when(s.axes.isNotNull(), F.transform(s.j, lambda p: let(sub(p, at(s.j, 0)), lambda q: F.transform(s.axes, lambda a: dot(q, a)))))

    return let(F.struct(palm_axes(joints).alias("axes"), joints.alias("j")), moved)


def expand_box(b: Column, pad: float, width: float, height: float) -> Column:
    """The square around the box's centre whose side is its longer one (2 at least) times pad,
    within the image."""
    half = F.greatest(at(b, 2) - at(b, 0), at(b, 3) - at(b, 1), F.lit(2.0)) * (pad / 2)
    x, y = (at(b, 0) + at(b, 2)) / 2, (at(b, 1) + at(b, 3)) / 2
    return clamp_box(vec(x - half, y - half, x + half, y + half), width, height)


def scaled_box(b: Column, scale: float, width: int, height: int) -> Column:
    """The box, each side 2 at least, grown by scale about its centre, within the pixels."""
    low, high = F.lit(0.0), {0: F.lit(float(width - 1)), 1: F.lit(float(height - 1))}

    def edge(axis: int, sign: int) -> Column:
        half = F.greatest(at(b, axis + 2) - at(b, axis), F.lit(2.0)) * (scale / 2)
        return F.least(high[axis], F.greatest(low, (at(b, axis) + at(b, axis + 2)) / 2 + sign * half))

    return vec(edge(0, -1), edge(1, -1), edge(0, 1), edge(1, 1))


def box_xywh(b: Column) -> Column:
    """First corner and sides, 1 at least."""
    return vec(at(b, 0), at(b, 1), F.greatest(F.lit(1.0), at(b, 2) - at(b, 0)), F.greatest(F.lit(1.0), at(b, 3) - at(b, 1)))


def unit(v: Column) -> Column:
    """v at length 1; zeros where it is shorter than 1e-9."""
    return let(v, lambda u: F.when(norm(u) > 1e-9, scaled(u, 1 / norm(u))).otherwise(scaled(u, F.lit(0.0))))


def knuckle_axes(joints: Column) -> Column:
    """Rows x, y, z of the frame of the knuckles: x from the little finger's base to the index
    base, z normal to it and the way from the wrist to their middle, y = z cross x; null where
    one of these has no length."""
    index, little, wrist = at(joints, 5), at(joints, 17), at(joints, 0)
    middle = F.zip_with(index, little, lambda a, b: (a + b) / 2)
    return let(
        F.struct(unit(sub(index, little)).alias("x"), unit(sub(middle, wrist)).alias("u")),
        lambda s: let(
            F.struct(s.x.alias("x"), unit(cross(s.x, s.u)).alias("z")),
            lambda t: F.when((norm(t.x) > 0.5) & (norm(t.z) > 0.5), F.array(t.x, unit(cross(t.z, t.x)), t.z)),
        ),
    )


def rotation_degrees(a: Column, b: Column) -> Column:
    """Angle between two rotation matrices given as rows."""

    def angle(s: Column) -> Column:
        trace = dot(at(s.a, 0), at(s.b, 0)) + dot(at(s.a, 1), at(s.b, 1)) + dot(at(s.a, 2), at(s.b, 2))
        return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (trace - 1) / 2))))

    return let(F.struct(a.alias("a"), b.alias("b")), angle)


def project(p: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Pixel of a point before a pinhole camera; null at or behind it."""
    return F.when(at(p, 2) > 1e-6, vec(at(p, 0) / at(p, 2) * fx + cx, at(p, 1) / at(p, 2) * fy + cy))


def affine(q: Column, m: list[list[float]]) -> Column:
    """A pixel under a 2 x 3 matrix."""
    return vec(*[at(q, 0) * r[0] + at(q, 1) * r[1] + r[2] for r in m])


def inverse_affine(q: Column, m: list[list[float]]) -> Column:
    """affine() undone; the pixel itself where the matrix has no inverse."""
    (a, b, c), (d, e, f) = m
    full = a * e - b * d
    if abs(full) < 1e-10:
        return q
    x, y = at(q, 0) - c, at(q, 1) - f
    return vec((x * e - y * b) / full, (y * a - x * d) / full)


def from_crop(q: Column, x: Column, y: Column, size: Column, mirrored: Column) -> Column:
    """A point of a square crop (from its centre, in its sides) as a pixel of the image."""
    return vec(F.when(mirrored, -at(q, 0)).otherwise(at(q, 0)) * size + x, at(q, 1) * size + y)


def points_box(points: Column, least: int = 1) -> Column:
    """The box around the points (structs with x and y) whose coordinates are finite; null with
    fewer than `least` of them."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.filter(points, lambda p: F.coalesce(fine(p.x) & fine(p.y), F.lit(False)))
    edges = lambda g: vec(F.array_min(g.x), F.array_min(g.y), F.array_max(g.x), F.array_max(g.y))
    return let(good, lambda g: F.when(F.size(g) >= least, edges(g)))


def clipped_box(b: Column, width: int, height: int) -> Column:
    """The box within the pixels, each side 2 at least; null where one is under 4."""

    def clip(x: Column, low, high) -> Column:
        return F.least(F.lit(float(high)), F.greatest(low, x))

    x1, y1 = clip(at(b, 0), F.lit(0.0), width - 2), clip(at(b, 1), F.lit(0.0), height - 2)
    whole = let(vec(x1, y1), lambda p: vec(at(p, 0), at(p, 1), clip(at(b, 2), at(p, 0) + 2, width - 1), clip(at(b, 3), at(p, 1) + 2, height - 1)))
    return let(whole, lambda w: F.when((at(w, 2) - at(w, 0) >= 4) & (at(w, 3) - at(w, 1) >= 4), w))


def box_corners(b: Column, scale: float = 1.0) -> Column:
    """The four corners, clockwise from the first."""
    return F.array(*[vec(at(b, i) * scale, at(b, j) * scale) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))])


def is_points(v: Column, least: int = 1) -> Column:
    """Whether an array column has `least` points or more, all of three finite numbers."""
    return F.coalesce((F.size(v) >= least) & F.forall(v, lambda p: F.coalesce((F.size(p) == 3) & finite(p), F.lit(False))), F.lit(False))


def rotated(r: Column, v: Column) -> Column:
    """A matrix (array of rows) times a vector."""
    return let(v, lambda u: F.transform(r, lambda row: dot(row, u)))

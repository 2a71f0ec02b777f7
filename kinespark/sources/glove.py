"""Hands of a sensor glove's CSV: per-joint columns to 21 points, all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import vectors as V

#: The sensor's joints of a hand, wrist first, then each finger from its base; the
#: thumb lacks a tip. Column names are prefix, joint, "-Joint-Posi-" and the axis.
JOINTS = {
    "wrist": ["Hand"],
    "thumb": ["HandThumb1", "HandThumb2", "HandThumb3"],
    "index": ["InHandIndex", "HandIndex1", "HandIndex2", "HandIndex3"],
    "middle": ["InHandMiddle", "HandMiddle1", "HandMiddle2", "HandMiddle3"],
    "ring": ["InHandRing", "HandRing1", "HandRing2", "HandRing3"],
    "pinky": ["InHandPinky", "HandPinky1", "HandPinky2", "HandPinky3"],
}


def column(side: str, joint: str, axis: str) -> str:
    return f"{side}{joint}-Joint-Posi-{axis}"


def joint_position(columns: list[str], side: str, joint: str, scale: float) -> Column:
    """A joint's point; null where a column is missing, empty or not finite."""
    names = [column(side, joint, a) for a in "xyz"]
    if not set(names) <= set(columns):
        return F.lit(None).cast("array<double>")
    v = F.array(*[F.col(f"`{n}`").cast("double") * scale for n in names])
    return F.when(V.finite(v), v)


def beyond(a: Column, b: Column) -> Column:
    """The point as far beyond b as b is beyond a."""
    return F.zip_with(b, a, lambda y, x: y + (y - x))


def hand_joints(columns: list[str], side: str, scale: float = 1.0) -> Column:
    """21 points of a side: wrist, the thumb with a tip beyond its last joint, and four joints of
    each other finger; null if any joint is."""
    own = {f: [joint_position(columns, side, j, scale) for j in joints] for f, joints in JOINTS.items()}
    thumb = own["thumb"]
    points = [*own["wrist"], *thumb, beyond(thumb[-2], thumb[-1])]
    for finger in ("index", "middle", "ring", "pinky"):
        points += own[finger]
    return V.let(F.array(*points), lambda p: F.when(F.forall(p, lambda x: x.isNotNull()), p))


def hands(rows: DataFrame, frame: str = "Frame-No", sides: tuple[str, ...] = ("Left", "Right"), scale: float = 1.0, offset: int = 1) -> DataFrame:
    """(group_id, hand, joints, local, palm): the glove's points as they are, from the wrist, and
    in the palm frame; group_id is the frame number with `offset`. Sides with a missing joint give
    no row; a degenerate palm is null."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("hand"), hand_joints(rows.columns, s, scale).alias("joints")) for s in sides]))
    found = rows.select((F.floor(F.col(f"`{frame}`")) + offset).cast("long").alias("group_id"), each.alias("s")).select("group_id", "s.*").where("joints is not null")
    wrist = F.get("joints", F.lit(0))
    local = F.transform("joints", lambda p: F.zip_with(p, wrist, lambda a, b: a - b))
    return found.withColumn("local", local).withColumn("palm", V.palm_local(F.col("joints")))

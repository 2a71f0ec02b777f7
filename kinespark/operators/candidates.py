"""From detector and predictor records to candidates: explosion and checks of nested hands, choice
of the field that holds the points, hypotheses of a job, and the last or best record of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions import sides
from kinespark.functions import vectors as V

from .select import first_by

#: Points of a hand.
POINTS = 21
#: For each space the fields of whole hands and of single joints, in the order in
#: which they are tried, and the spaces that may fall back to the plain palm space.
SPACES = {
    "palm-local": (["palm_local_joints_m"], ["palm_local_m"]),
    "raw-palm-local": (["raw_palm_local_joints_m"], ["raw_palm_local_m"]),
    "zero-shot-static-palm-local": (["static_calibrated_palm_local_joints_m"], ["static_calibrated_palm_local_m"]),
    "smoothed-palm-local": (["smoothed_palm_local_joints_m"], ["smoothed_palm_local_m"]),
    "causal-smoothed-palm-local": (["causal_smoothed_palm_local_joints_m"], ["causal_smoothed_palm_local_m"]),
    "adaptive-causal-palm-local": (["adaptive_causal_palm_local_joints_m"], ["adaptive_causal_palm_local_m"]),
    "root-relative": (["local_joints_m"], ["root_relative_headset_m"]),
    "glove-calibrated-palm-local": (["glove_calibrated_palm_local_joints_m", "palm_local_joints_m"], ["glove_calibrated_palm_local_m", "palm_local_m"]),
    "glove-calibrated-root-relative": (["glove_calibrated_root_relative_joints_m", "local_joints_m"], ["glove_calibrated_root_relative_m", "root_relative_headset_m"]),
}
FALL_BACK = ("raw-palm-local", "zero-shot-static-palm-local", "smoothed-palm-local", "causal-smoothed-palm-local", "adaptive-causal-palm-local")


def output_fields(space: str) -> tuple[str, str]:
    """The fields that corrected points of a space are written to: of the hand and of a joint."""
    kind = "root_relative" if "root-relative" in space else "palm_local"
    return f"glove_calibrated_{kind}_joints_m", f"glove_calibrated_{kind}_m"


def primary_field(choice: str, enabled: set[str]) -> str:
    """The field of a fused hand's main output; an error where the filter that makes it is off."""
    fields = {"raw": "raw_joints", "static-calibrated": "static_joints", "smoothed": "smoothed", "causal-smoothed": "causal", "adaptive-causal": "adaptive_causal"}
    found = fields[choice]
    if found not in enabled:
        raise ValueError(f"{choice} is asked for, but its filter is off")
    return found


def _within(fields: list[str], name: str, known: list[str]) -> list[Column]:
    return [F.col(f"{name}.{f}") for f in fields if f in known]


def positions(hand: str, fields: list[str], joint_fields: list[str], space: str, fall_back: bool = False) -> Column:
    """The 21 points of a hand (a struct column `hand` with `fields`) in a space: the first of the
    space's fields with 21 finite points, else those of its array `joints` (each with `index` and
    `joint_fields`), if all 21 are there; null else. Of joints of one index the last counts."""
    whole, single = (list(x) for x in SPACES[space])
    if fall_back and space in FALL_BACK:
        whole, single = [*whole, "palm_local_joints_m"], [*single, "palm_local_m"]
    options = [F.when(V.is_points(F.slice(c, 1, POINTS), POINTS), F.slice(c, 1, POINTS)) for c in _within(whole, hand, fields)]
    names = [f for f in single if f in joint_fields]
    if "joints" in fields and names:

        def own(j: Column) -> Column:
            return F.coalesce(*[F.when((F.size(j[f]) == 3) & V.finite(j[f]), j[f]) for f in names])

        placed = F.filter(F.transform(F.col(f"{hand}.joints"), lambda j: F.struct(j["index"].alias("i"), own(j).alias("p"))), lambda e: e.p.isNotNull())
        built = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.try_element_at(F.filter(placed, lambda e: e.i == i), F.lit(-1)).p)
        options.append(F.when(F.forall(built, lambda p: p.isNotNull()), built))
    return F.coalesce(*options) if options else F.lit(None).cast("array<array<double>>")


def hands_by_group(records: DataFrame, space: str, fall_back: bool = False) -> DataFrame:
    """(group_id, hand, joints): points of each labelled hand in a space. records: pos, group_id,
    hands (array of structs with `handedness`). Of the records of a group the last with a hand
    that counts replaces the others; of a record's hands of one side the last counts."""
    kind = records.schema["hands"].dataType.elementType
    fields = kind.fieldNames()
    joint_fields = kind["joints"].dataType.elementType.fieldNames() if "joints" in fields else []
    each = records.select("pos", "group_id", F.posexplode("hands").alias("at", "h")).withColumn("joints", positions("h", fields, joint_fields, space, fall_back))
    good = each.where(sides.is_side(F.col("h.handedness")) & F.col("joints").isNotNull()).select("pos", "group_id", "at", F.col("h.handedness").alias("hand"), "joints")
    last = good.withColumn("__last", F.max("pos").over(Window.partitionBy("group_id"))).where("pos = __last")
    return first_by(last, ["group_id", "hand"], [F.desc("at")]).select("group_id", "hand", "joints")


def last_hands(records: DataFrame, type_: str) -> DataFrame:
    """(group_id, hand, h): the last labelled hand of each group and side over all records of a
    type. records: pos, type, group_id, hands."""
    each = records.where(F.col("type") == type_).select("pos", "group_id", F.posexplode("hands").alias("at", "h")).where(sides.is_side(F.col("h.handedness")))
    return first_by(each.withColumn("hand", F.col("h.handedness")), ["group_id", "hand"], [F.desc("pos"), F.desc("at")]).select("group_id", "hand", "h")


def landmarks_2d(records: DataFrame, least_score: float, cameras: list[str] | None = None) -> DataFrame:
    """(group_id, hand, camera_id, points, score): 21 finite pixels of each labelled hand whose
    score reaches `least_score`, the last of a key. records: pos, group_id, camera_id, hands."""
    each = records.where(F.length("camera_id") > 0).select("pos", "group_id", "camera_id", F.posexplode("hands").alias("at", "h"))
    if cameras is not None:
        each = each.where(F.col("camera_id").isin(*cameras))
    fine = lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    points = F.transform(F.filter("h.landmarks_rectified_px", lambda p: fine(p.x) & fine(p.y)), lambda p: F.array(p.x, p.y))
    each = each.withColumn("points", points).where(sides.is_side(F.col("h.handedness")) & (F.col("h.handedness_score") >= least_score) & (F.size("points") >= POINTS))
    each = each.withColumn("hand", F.col("h.handedness"))
    return first_by(each, ["group_id", "hand", "camera_id"], [F.desc("pos"), F.desc("at")]).select("group_id", "hand", "camera_id", F.slice("points", 1, POINTS).alias("points"), F.col("h.handedness_score").alias("score"))


def boxed_hands(records: DataFrame) -> DataFrame:
    """(group_id, camera_id, at, box, label, label_source, confidence, score, h) of each hand with
    a box of four numbers, with the label that counts; see sides.best_label()."""
    each = records.select("group_id", "camera_id", F.posexplode("hands").alias("at", "h")).where(F.size("h.bbox") == 4)
    names = {c for c in records.schema["hands"].dataType.elementType.fieldNames()}
    field = lambda n, kind: F.col(f"h.{n}") if n in names else F.lit(None).cast(kind)
    best = sides.best_label(field("locked_handedness", "string"), field("handedness", "string"), field("handedness_source", "string"), field("is_right", "int"), field("handedness_confidence", "double"), field("score", "double"))
    return each.withColumn("__l", best).select("group_id", "camera_id", "at", F.col("h.bbox").cast("array<double>").alias("box"), F.col("__l.label").alias("label"), F.col("__l.source").alias("label_source"), F.col("__l.confidence").alias("confidence"), field("score", "double").alias("score"), "h")


def jobs(records: DataFrame, type_: str, camera: str | None = None, debug: bool = False) -> DataFrame:
    """The jobs of the records of a type, one row each, without those for debugging unless asked."""
    rows = records.where(F.col("type") == type_)
    rows = rows.where(F.col("camera_id") == camera) if camera else rows
    each = rows.select(F.explode("jobs").alias("j")).select("j.*")
    return each if debug else each.where(~F.coalesce("debug_only", F.lit(False)))


def hypotheses(df: DataFrame, scales: list[float], width: int, height: int) -> DataFrame:
    """Each job (with `label` and `box`) as the crops to predict: a known side, or both for an
    unknown one, times the scales of the box. Adds hand, is_right, status, scale and crop."""
    known = sides.is_side(F.col("label"))
    side = lambda name, status: F.struct(F.lit(name).alias("hand"), F.lit(status).alias("status"))
    both = F.array(side("Left", "unknown_hypothesis"), side("Right", "unknown_hypothesis"))
    options = F.when(known, F.array(F.struct(F.col("label").alias("hand"), F.lit("known").alias("status")))).otherwise(both)
    rows = df.withColumn("__s", F.explode(options)).withColumn("scale", F.explode(F.array(*[F.lit(float(s)) for s in scales])))
    return rows.withColumns({"hand": F.col("__s.hand"), "status": F.col("__s.status"), "is_right": sides.is_right(F.col("__s.hand")), "crop": _crop(scales, width, height)}).drop("__s")


def _crop(scales: list[float], width: int, height: int) -> Column:
    found = F.lit(None).cast("array<double>")
    for s in scales:
        found = F.when(F.col("scale") == float(s), V.scaled_box(F.col("box"), s, width, height)).otherwise(found)
    return found


def choose_candidate(df: DataFrame, keys: list[str], mask: str = "mask_score", scale: str = "scale", status: str = "status", position: str = "pos") -> DataFrame:
    """The best candidate of each key: by mask score (none: -1), then the scale nearest to 1, then
    known sides, then position."""
    return first_by(df, keys, [F.desc(F.coalesce(mask, F.lit(-1.0))), F.abs(F.coalesce(scale, F.lit(1.0)) - 1), F.desc(F.coalesce(F.col(status) == "known", F.lit(False))), F.asc(position)])


def best_record(df: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """The best record of each key: by mask_score (none: -1), known sides, confidence (none: 0)
    and position."""
    return first_by(df, keys, [F.desc(F.coalesce("mask_score", F.lit(-1.0))), F.desc(F.coalesce(F.col("status") == "known", F.lit(False))), F.desc(F.coalesce("confidence", F.lit(0.0))), F.asc(position)])


def predictions(records: DataFrame, types: list[str], fields: list[str], least: int = POINTS, needs: list[str] | None = None) -> DataFrame:
    """Records of the given types with a side, a camera and points that count, with `joints`: the
    first of `fields` that isn't empty, which must hold `least` finite points or more. `needs`
    names columns that must not be null."""
    found = F.lit(None).cast("array<array<double>>")
    for f in reversed(fields):
        found = F.when(F.size(F.col(f)) > 0, F.col(f)).otherwise(found)
    rows = records.where(F.col("type").isin(*types) & sides.is_side(F.col("hand")) & (F.length("camera_id") > 0)).withColumn("joints", found)
    rows = rows.where(V.is_points(F.col("joints"), least))
    for c in needs or []:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def palm_candidates(rows: DataFrame) -> DataFrame:
    """predictions() in the palm frame of their first 21 points; degenerate palms go."""
    local = V.palm_local(F.slice("joints", 1, POINTS))
    return rows.withColumn("joints", local).where("joints is not null")


def temporal_score(quality: Column, error: Column, cap: float, weight: float) -> Column:
    """Quality less `weight` times the share of the error to the hand before in `cap`."""
    return quality - F.when(error.isNotNull(), weight * F.least(error, F.lit(cap)) / max(cap, 1e-6)).otherwise(0.0)


def observation_weight(score: Column, error: Column, anchor: Column, least: float, cap: float, boost: float) -> Column:
    """A view's weight: its score, `least` at least, less for a jump from the hand before, more
    for the anchor, and `least` at least again."""
    w = F.greatest(score, F.lit(least)) * F.when(error.isNull(), 1.0).otherwise(V.robust_weight(error, cap)) * F.when(anchor, boost).otherwise(1.0)
    return F.greatest(w, F.lit(least))


def joint_structs(joints: Column, palm: Column, names: list[str]) -> Column:
    """Points as structs (index, name, position, palm_local_m); the palm's points fall back to
    the points themselves, and entries that aren't points go."""
    at = lambda i: F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), i + 1), F.concat(F.lit("joint_"), i.cast("string")))
    all_ = F.transform(joints, lambda p, i: F.struct(i.alias("index"), at(i).alias("name"), p.alias("position"), F.coalesce(F.get(palm, i), p).alias("palm_local_m")))
    return F.filter(all_, lambda s: F.coalesce(F.size(s.position) == 3, F.lit(False)))


def with_points(joints: Column, points: Column, field: str) -> Column:
    """An array of joint structs with `field` set to the point of the struct's index; structs
    whose index has no point keep what they have."""
    return F.transform(joints, lambda j: F.when((j["index"] >= 0) & (j["index"] < F.size(points)), j.withField(field, F.get(points, j["index"]))).otherwise(j.withField(field, j[field])))


def written(df: DataFrame, space: str, points: str, overwrite: bool = False) -> DataFrame:
    """df with corrected points in the fields for them, and in the space's own too if asked."""
    target, _ = output_fields(space)
    out = df.withColumn(target, F.col(points))
    return out.withColumn(SPACES[space][0][-1], F.col(points)) if overwrite else out


def byte_account(lines: DataFrame, type_: str, heavy: list[str]) -> DataFrame:
    """One row: records of a type, bytes of their lines, and how many hold each heavy field.
    lines: the record's columns with n_bytes."""
    rows = lines.where(F.col("type") == type_)
    return rows.agg(F.count("*").alias("records"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"), *[F.count_if(F.col(c).isNotNull()).alias(f"with_{c}") for c in heavy])


def refined_candidates(rows: DataFrame, level1: DataFrame, keys: list[str], level1_weight: float, cap: float, temporal_weight: float = 0.25) -> DataFrame:
    """rows (keys, camera_id, quality, joints in the palm frame) with `error` and `score`: quality,
    plus `level1_weight` times the camera's score of the stage before, less `temporal_weight`
    times the mean distance to the hand before (as a share of `cap`, 1 at most). level1: keys,
    scores (map of camera to score), previous (palm points of the frame before, or null)."""
    joined = rows.join(level1, keys, "left")
    apart = F.transform(F.arrays_zip("joints", "previous"), lambda e: V.norm(V.sub(e["joints"], e["previous"])))
    error = F.when(F.col("previous").isNotNull(), F.aggregate(apart, F.lit(0.0), lambda s, v: s + v) / F.size("joints"))
    bonus = F.coalesce(F.try_element_at("scores", F.col("camera_id")), F.lit(0.0))
    joined = joined.withColumn("error", error)
    penalty = F.when(F.col("error").isNotNull(), F.least("error", F.lit(cap)) / max(cap, 1e-8)).otherwise(0.0)
    return joined.withColumn("score", F.col("quality") + level1_weight * F.when(V.finite(F.array(bonus)), bonus).otherwise(0.0) - temporal_weight * penalty).drop("scores", "previous")


def attached(rows: DataFrame, landmarks: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the 21 pixels and their score of landmarks_2d(), null where there are none."""
    return rows.join(landmarks.select(*keys, F.col("points").alias("landmarks"), F.col("score").alias("landmark_score")), keys, "left")


def greatest_error(errors: Column) -> Column:
    """The greatest value of a map of errors that isn't null or NaN; null without one."""
    return F.array_max(F.filter(F.map_values(errors), lambda v: v.isNotNull() & ~F.isnan(v)))


def displayed(position: Column, own: Column, hand: Column, space: str, apart: float = 0.09) -> Column:
    """A joint's point to show in a space: its own field there, else its position; palm-local hands
    are moved apart by side. Null where that isn't a point."""
    p = F.coalesce(own, position)
    shift = F.when(hand == "Left", -apart).otherwise(apart) if space == "palm-local" else F.lit(0.0)
    return F.when((F.size(p) == 3) & V.finite(p), V.vec(V.at(p, 0) + shift, V.at(p, 1), V.at(p, 2)))


def online_jobs(boxed: DataFrame, pad: float, width: float, height: float) -> DataFrame:
    """boxed_hands() as jobs of a live run: the box grown, an unknown side named so."""
    return boxed.select(
        "group_id", "camera_id", F.col("at").alias("job"), V.expand_box(F.col("box"), pad, width, height).alias("box"), F.coalesce("label", F.lit("unknown")).alias("label"),
        F.coalesce("label_source", F.lit("sam3_only_unknown")).alias("label_source"), "confidence", sides.is_right(F.col("label")).alias("is_right"), F.lit("sam3").alias("origin"), F.lit(False).alias("debug_only"),
    )

"""Files of a rig as small tables: intrinsics, poses and corrections by camera. A rig has few
cameras, so later joins may broadcast them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.functions import vectors as V

MATRIX = "array<array<double>>"


def _shaped(m: Column, rows: int, columns: int) -> Column:
    """Whether a matrix has this shape and only finite numbers."""
    return F.coalesce((F.size(m) == rows) & F.forall(m, lambda r: F.coalesce((F.size(r) == columns) & V.finite(r), F.lit(False))), F.lit(False))


def _map(spark: SparkSession, path: str, field: str, value: str) -> DataFrame:
    """(camera_id, v) of the JSON object `field` of a file; none where the file lacks it."""
    whole = spark.read.schema(f"`{field}` map<string,{value}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return whole.select(F.explode(field).alias("camera_id", "v"))


def intrinsics(spark: SparkSession, path: str, field: str = "new_intrinsics") -> DataFrame:
    """(camera_id, k): the 3 x 3 matrices of the cameras."""
    found = _map(spark, path, field, MATRIX)
    return found.where(_shaped(F.col("v"), 3, 3)).select("camera_id", F.col("v").alias("k"))


def poses(spark: SparkSession, path: str, field: str = "cameras", name: str = "T_H_C") -> DataFrame:
    """(camera_id, origin, rotation) from 4 x 4 transforms of cameras to the rig."""
    found = _map(spark, path, field, f"struct<{name}:{MATRIX}>").select("camera_id", F.col(f"v.{name}").alias("m")).where(_shaped(F.col("m"), 4, 4))
    rotation = F.transform(F.slice("m", 1, 3), lambda r: F.slice(r, 1, 3))
    return found.select("camera_id", F.transform(F.slice("m", 1, 3), lambda r: F.get(r, F.lit(3))).alias("origin"), rotation.alias("rotation"))


def geometry(poses_: DataFrame, intrinsics_: DataFrame) -> DataFrame:
    """(camera_id, k, origin, rotation) of the cameras that have both."""
    return poses_.join(F.broadcast(intrinsics_), "camera_id").select("camera_id", "k", "origin", "rotation")


def projection_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, affine): the 2 x 3 corrections of projected pixels with the right shape."""
    field = "camera_projection_corrections"
    found = _map(spark, path, field, f"struct<affine_projected_to_rectified_px:{MATRIX}>").select("camera_id", F.col("v.affine_projected_to_rectified_px").alias("affine"))
    return found.where(_shaped(F.col("affine"), 2, 3))


def pose_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, delta): the 4 x 4 corrections of poses with the right shape."""
    found = _map(spark, path, "camera_corrections", f"struct<delta_T_H:{MATRIX}>").select("camera_id", F.col("v.delta_T_H").alias("delta"))
    return found.where(_shaped(F.col("delta"), 4, 4))

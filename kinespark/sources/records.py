"""Record sources and sinks: strict JSON lines, group ranges, shard merges, and the views over
the given tables that stand for recorded hands, boxes and sensor streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES = "group_id long, camera_id string, timestamp_unix_ns long, timestamp_monotonic_ns long, image_path string, width int, height int, skew_us double"
HANDS = (
    "type string, group_id long, camera_id string, hands array<struct<hand_index:int,handedness:string,handedness_score:double,bbox:array<double>,score:double,track_id:string,"
    "locked_handedness:string,landmarks_rectified_px:array<struct<x:double,y:double,z:double>>,rectified_ray_cam:array<struct<x:double,y:double,z:double>>>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict scan of JSON lines: blank lines are skipped; a malformed line is an error that names
    the file and the line's text."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    broken = F.raise_error(F.concat_ws(" ", F.lit("malformed JSON in"), "file", F.lit("at line"), F.substring("value", 1, 200)))
    whole = F.from_json("value", f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    return lines.withColumn("r", whole).withColumn("r", F.when(F.col("r.__broken").isNull(), F.col("r")).otherwise(broken)).select("r.*").drop("__broken")


def read_jsonl_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_jsonl, with `n_bytes` of each line, for accounts of bytes."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.octet_length("value").alias("n_bytes")).select("r.*", "n_bytes")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls are empty."""
    df.write.option("header", True).option("emptyValue", "").csv(path)


def frame_bounds(df: DataFrame, frame: str, keys: list[str]) -> DataFrame:
    """(keys, low, high, n): the range of frames of each key and their number."""
    return df.where(F.col(frame).isNotNull()).groupBy(*keys).agg(F.min(frame).alias("low"), F.max(frame).alias("high"), F.count("*").alias("n"))


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """"3-9,12" as inclusive ranges; a descending range is an error, an empty text no filter."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, dash, high = part.partition("-")
        low, high = int(low), int(high if dash else low)
        if high < low:
            raise ValueError(f"descending range {part}")
        out.append((low, high))
    return out


def in_ranges(column: Column, ranges: list[tuple[int, int]]) -> Column:
    """Ranges stay ranges in the predicate, however many ids they span."""
    found = F.lit(not ranges)
    for low, high in ranges:
        found = found | column.between(low, high)
    return found


def frame_filter(df: DataFrame, groups: str = "", cameras: tuple[str, ...] = ()) -> DataFrame:
    found = df.where(in_ranges(F.col("group_id"), parse_ranges(groups)))
    return found.where(F.col("camera_id").isin(*cameras)) if cameras else found


def explode_hands(records: DataFrame) -> DataFrame:
    """One row for each hand of each record; records without hands give none."""
    return records.select("group_id", "camera_id", F.explode("hands").alias("h")).select("group_id", "camera_id", "h.*")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that aren't blank with their place in the file: 0 and 1 for its first two, 2 for the
    rest. A scan gives the lines of a split in order, and only one split starts a file."""
    split, at = None, 0
    for batch in batches:
        files, values, places = [], [], []
        for value, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, start) != split:
                split, at = (file, start), 0 if start == 0 else 2
            if value.strip():
                files.append(file)
                values.append(value)
                places.append(at)
                at = min(2, at + 1)
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(values, pa.string()), pa.array(places, pa.int32())], ["file", "value", "at"])


def read_sensor_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sensor CSVs, each with a header before which a line with the number of rows may stand. All
    columns are doubles, and what isn't a number is null. A file's own header names its columns;
    columns that only other files have are null. A file with another number of rows than it
    declares is an error. The first two lines and the number of rows of each file come to the
    driver."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = lines.mapInArrow(_placed, "file string, value string, at int")
    heads: dict[str, list[str]] = {}
    for r in sorted(placed.where("at < 2").collect(), key=lambda r: (r["file"], r["at"])):
        heads.setdefault(r["file"], []).append(r["value"].strip())
    declared = {f: int(h[0]) for f, h in heads.items() if h[0].isdigit()}
    header = {f: h[int(f in declared)] for f, h in heads.items()}
    kinds = sorted(set(header.values()))
    table = spark.createDataFrame([(f, kinds.index(h), 1 + int(f in declared)) for f, h in header.items()], "file string, kind int, first int")
    rows = placed.join(F.broadcast(table), "file").where("at >= first")  # one row a file
    if declared:
        found = {r["file"]: r["count"] for r in rows.groupBy("file").count().collect()}
        if wrong := {f: (n, found.get(f, 0)) for f, n in declared.items() if n != found.get(f, 0)}:
            raise ValueError(f"rows declared and found differ: {wrong}")
    out = None
    for i, text in enumerate(kinds):
        names = [n.strip() for n in text.split(",")]
        cells = F.from_csv("value", ", ".join(f"`{n}` string" for n in names))
        part = rows.where(F.col("kind") == i).select(cells.alias("r")).select(*[F.expr(f"try_cast(trim(r.`{n}`) as double)").alias(n) for n in names])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merge_shards(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """All rows, the first of each key: by shard, then by the row's other columns in order."""
    parts = [s.withColumn("__shard", F.lit(i)) for i, s in enumerate(shards)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in keys and c != "__shard"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__shard", *rest))
    return every.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__shard")


def shard_conflicts(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, n_rows, n_forms): n_forms over 1 marks keys whose repeated rows differ."""
    every = shards[0]
    for s in shards[1:]:
        every = every.unionByName(s)
    form = F.to_json(F.struct(*sorted(every.columns)))
    return every.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(F.md5(form)).alias("n_forms"))


def strict_merge(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """merge_shards(), but a key whose rows differ is an error."""
    bad = shard_conflicts(shards, keys).where("n_forms > 1").select(*keys)
    fail = F.raise_error(F.lit("conflicting rows for one key"))
    first = merge_shards(shards, keys).join(bad.withColumn("__bad", F.lit(1)), keys, "left")
    return first.withColumn("__bad", F.when(F.col("__bad").isNotNull(), fail)).where("__bad is null").drop("__bad")


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(position)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def frame_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of frames (group_id, video_frame_index, rectified_image_path) as a table."""
    schema = "group_id long, video_frame_index long, rectified_image_path string"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def strided_records(records: DataFrame, type_: str, position: str, stride: int = 1, most: int | None = None) -> DataFrame:
    """The records of a type at every stride-th position of the file, the first `most` of them."""
    rows = records.where((F.col("type") == type_) & (F.col(position) % stride == 0))
    return rows.orderBy(position).limit(most) if most else rows


def image_path(camera: Column, path: Column) -> Column:
    """A frame's path within the rectified images: camera and file name."""
    return F.concat_ws("/", camera, F.element_at(F.split(path, "/"), -1))


def relocated(path: Column, folder: str, base: str | None = None) -> list[Column]:
    """Where a stale asset path may be now, best first: its part from "masks" on under `folder`,
    and its part from "chunks" on among the boxes of `base`; null where it lacks these."""
    tail = lambda mark: F.nullif(F.regexp_extract(path, rf"(?:^|/)({mark}/.*)$", 1), F.lit(""))
    found = [F.concat(F.lit(f"{folder}/"), tail("masks"))]
    return found + ([F.concat(F.lit(f"{base}/sam3_bboxes/"), tail("chunks"))] if base else [])


def existing(df: DataFrame, options: list[Column], files: DataFrame, name: str = "asset") -> DataFrame:
    """df with the first of the options that is among the listed files (column `path`), null
    without one; files are joined, never looked up row by row."""
    out = df.withColumn("__id", F.monotonically_increasing_id())
    each = out.select("__id", F.posexplode(F.array(*options)).alias("at", "path")).where("path is not null")
    found = each.join(files.select("path").distinct(), "path").groupBy("__id").agg(F.min_by("path", "at").alias(name))
    return out.join(found, "__id", "left").drop("__id")


def listed_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length) of the files that match a pattern, by Spark's own listing."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length").distinct().orderBy("path")


def synced_name(stem: str, glove: float, camera: float, cut: tuple[int, int] | None = None) -> str:
    """File name of a glove's records on a camera's clock, of a cut of groups if given."""
    from kinespark.functions.params import number_tag

    name = f"{stem}_camera_sync_g{number_tag(glove)}_c{number_tag(camera)}"
    return f"{name}_cut_{cut[0]:06d}_{cut[1]:06d}.jsonl" if cut else f"{name}.jsonl"


def keyframes_stream(spark: SparkSession, folder: str, schema: str = HANDS, files: int = 1) -> DataFrame:
    """Keyframe records as they come: whole files that appear in a folder. A line counts once its
    file is complete, so writers move finished files in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View of `embeddings` as per-camera hands: 21 points each, with gaps in the groups."""
    v, g = F.col("vec_id"), F.floor(F.col("vec_id") / 8)
    rows = table(spark, sf_dir, "embeddings").where((v % 37 != 0) & ~((g % 17 == 5) | (g % 23).isin(7, 8) | (g % 29).isin(11, 12, 13)))
    point = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get("embedding", j * 3 + k).cast("double")))
    return rows.select(
        v.alias("pos"),
        F.floor(g / 64).alias("sequence_id"),
        g.alias("group_id"),
        F.concat(F.lit("C"), (v % 4).cast("string")).alias("camera_id"),
        F.when(F.floor(v / 4) % 2 == 0, "Left").otherwise("Right").alias("hand"),
        ((v * 37 % 101) / F.lit(100.0)).alias("quality"),
        point.alias("joints"),
    )


def joint_rows(h: DataFrame) -> DataFrame:
    """One row for each point: joint and its x, y, z."""
    others = [c for c in h.columns if c != "joints"]
    return h.select(*others, F.posexplode("joints").alias("joint", "p")).select(*others, "joint", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), F.get("p", F.lit(2)).alias("z"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View of `lineitem` as detections, every row one of them: an order is an image, so a key
    is small by nature and keys grow with the table. Detections are numbered within their key."""
    c = F.col
    base = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("group_id"), F.concat(F.lit("C"), (c("l_orderkey") % 4).cast("string")).alias("camera_id"),
        (c("l_partkey") % 1200).cast("double").alias("x1"), (c("l_suppkey") * 7 % 900).cast("double").alias("y1"),
        (20 + c("l_quantity") * 6).alias("w"), (20 + c("l_discount") * 1500).alias("h"), (c("l_tax") / 0.08).alias("score"),
        F.when(c("l_returnflag") == "A", "mediapipe").otherwise("sam3").alias("origin"), "l_orderkey",
        F.when(c("l_partkey") % 3 == 0, "Left").when((c("l_partkey") % 3 == 1) | (c("l_returnflag") == "A"), "Right").alias("label"),
        F.when(c("l_suppkey") % 5 == 0, "prompt").when(c("l_suppkey") % 5 == 1, "hypothesis").otherwise("tracker").alias("label_source"), (c("l_suppkey") % 2).cast("double").alias("is_right"),
    )
    order = Window.partitionBy("group_id", "camera_id").orderBy("l_orderkey", "x1", "y1", "w", "h", "score", "origin", "label", "label_source")
    box = F.array("x1", "y1", c("x1") + c("w"), c("y1") + c("h")).alias("box")
    return base.withColumn("n", F.row_number().over(order)).select("group_id", "camera_id", "n", box, "score", "origin", "label", "label_source", "is_right")


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View of `events` as the 60 Hz streams of four recordings with missing frames."""
    return table(spark, sf_dir, "events").where("event_id % 13 <> 4").select(
        (F.floor(F.col("user_id") / 2) % 4).alias("recording"), F.col("event_id").alias("frame_no"), F.when(F.col("user_id") % 2 == 0, "Left").otherwise("Right").alias("hand"), F.col("value").alias("x")
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View of `events` as one series for each user, with gaps in `seq`."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", n.alias("seq"), F.col("value").alias("x")).where("seq % 11 <> 6")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View of `embeddings` as prediction records, some of another type, without a side, without
    points or with too few or broken ones."""
    v = F.col("vec_id")
    nan = F.lit(float("nan"))
    point = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get("embedding", j * 3 + k).cast("double")))
    quality = (v * 37 % 101) / F.lit(100.0)
    broken = F.transform("__p", lambda p, j: F.when(j == 4, F.array(nan, nan, nan)).otherwise(p))
    box = F.array((v * 13 % 1100).cast("double"), (v * 17 % 800).cast("double"), (v * 13 % 1100 + 40 + v % 90).cast("double"), (v * 17 % 800 + 30 + v % 70).cast("double"))
    return table(spark, sf_dir, "embeddings").withColumn("__p", point).select(
        v.alias("pos"),
        F.when(v % 19 == 7, "other").when(v % 2 == 0, "hand_prediction").otherwise("mesh_prediction").alias("type"),
        F.floor(v / 8).alias("group_id"),
        F.when(v % 41 == 5, "").otherwise(F.concat(F.lit("C"), (v % 4).cast("string"))).alias("camera_id"),
        F.when(v % 23 == 9, F.lit(None)).when(F.floor(v / 4) % 2 == 0, "Left").otherwise("Right").alias("hand"),
        F.when(v % 3 == 0, F.col("__p")).when(v % 3 == 1, F.slice("__p", 1, 0)).alias("mesh_joints"),
        F.when(v % 29 == 3, F.slice("__p", 1, 20)).when(v % 31 == 4, broken).otherwise(F.col("__p")).alias("own_joints"),
        F.when(v % 5 < 3, F.floor(quality * 4) / 4).alias("mask_score"),
        F.when(v % 5 == 3, quality).alias("detector_score"),
        (v % 7 == 0).alias("blurred"),
        F.when(v % 11 != 6, box).alias("box"),
        F.when(v % 4 == 0, "mediapipe+sam3").when(v % 4 == 1, "sam3").when(v % 4 == 2, "mediapipe").alias("origin"),
        F.when(v % 3 != 1, "known").otherwise("unknown_hypothesis").alias("status"),
        (1 + v % 3 / 10.0).alias("scale"),
        quality.alias("quality"),
    )


def hand_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View of hands() as records of a camera's frame with nested hands, some with points of a
    whole hand, some with joints one by one, some with one joint missing."""
    h = hands(spark, sf_dir)
    joints = F.transform("joints", lambda p, i: F.struct(i.alias("index"), p.alias("palm_local_m")))
    some = F.filter(joints, lambda j: (F.col("pos") % 4 != 0) | (j["index"] != 7))
    hand = F.struct(F.col("hand").alias("handedness"), F.when(F.col("pos") % 3 != 0, F.col("joints")).alias("palm_local_joints_m"), F.col("joints").alias("local_joints_m"), some.alias("joints"))
    grouped = h.withColumn("h", hand).groupBy("group_id", "camera_id").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("hs"))
    return grouped.select("pos", F.lit("frame").alias("type"), "group_id", "camera_id", F.col("hs.h").alias("hands"))


def glove_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View of `embeddings` as rows of a glove's CSV: 20 joints of either hand, now and then one
    of them missing."""
    from .glove import JOINTS, column

    joints = [j for finger in JOINTS.values() for j in finger]
    v = F.col("vec_id")
    columns = [F.floor(v / 1).cast("double").alias("Frame-No")]
    for side, flip in (("Left", 1.0), ("Right", -1.0)):
        for i, joint in enumerate(joints):
            for k, axis in enumerate("xyz"):
                value = F.get("embedding", F.lit(3 * i + k)).cast("double") * (flip if axis == "x" else 1.0)
                gone = (v % 7 == 2) if (side, i) == ("Right", 14) else F.lit(False)
                columns.append(F.when(~gone, value).alias(column(side, joint, axis)))
    return table(spark, sf_dir, "embeddings").select(*columns)


def first_groups(df: DataFrame, position: str, most: int) -> DataFrame:
    """The rows of the first `most` groups, by where each group comes first in the file; of groups
    that come first at the same place those of the smaller ids."""
    first = df.groupBy("group_id").agg(F.min(position).alias("__first")).orderBy("__first", "group_id").limit(most)
    return df.join(F.broadcast(first.select("group_id")), "group_id")  # at most `most` rows

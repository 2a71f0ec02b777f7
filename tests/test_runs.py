"""Runs that skip what is done, and figures of streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from kinespark.sources import incremental
from kinespark.streaming import figures, labels


def _inputs(spark, n):
    return spark.createDataFrame([(i if i else None, i * 2) for i in range(n)], "id long, v long")


def test_new_inputs_alone_are_added(spark, tmp_path):
    folder = str(tmp_path / "out")
    worked = []

    def made(df):
        worked.append(df.count())
        return df.where("v % 4 = 0").select("id", (F.col("v") + 1).alias("w"))  # some keys give no rows

    assert incremental.read(spark, folder, "id long, w long").count() == 0
    assert incremental.add_missing(_inputs(spark, 6), made, folder, ["id"]) == 6
    files = sorted(os.listdir(folder))
    assert incremental.add_missing(_inputs(spark, 6), made, folder, ["id"]) == 0 and worked == [6] and sorted(os.listdir(folder)) == files
    assert incremental.add_missing(_inputs(spark, 9), made, folder, ["id"]) == 3 and worked == [6, 3]
    assert sorted((r.id or 0, r.w) for r in incremental.read(spark, folder, "id long, w long").collect()) == [(i, 2 * i + 1) for i in range(0, 9, 2)]
    assert len(incremental.committed(spark, folder)) == 2 and incremental.clean(spark, folder) == []


def test_killed_run_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    incremental.add_missing(_inputs(spark, 3), lambda df: df, folder, ["id"])

    def broken(df):
        return df.withColumn("v", F.when(F.col("id") == 4, F.raise_error(F.lit("stop"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="stop"):
        incremental.add_missing(_inputs(spark, 5), broken, folder, ["id"])
    assert incremental.read(spark, folder, "id long, v long").count() == 3
    assert incremental.add_missing(_inputs(spark, 5), lambda df: df, folder, ["id"]) == 2
    assert incremental.read(spark, folder, "id long, v long").count() == 5
    assert len(incremental.clean(spark, folder)) == 1 and incremental.read(spark, folder, "id long, v long").count() == 5


def test_figures_of_a_stream(spark, tmp_path):
    """Counters equal a groupBy over what the stream gives; every batch has a time."""
    rows = [(f"C{i % 2}", i % 3, i, "Left" if i % 4 else "Right", 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "camera_id string, track_id long, t long, vote string, weight double")
    for lo in range(0, 60, 20):
        df.where(f"t between {lo} and {lo + 19}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = figures.Figures()
    spark.streams.addListener(seen)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        votes = figures.counted(stream, "votes", {"left": F.col("vote") == "Left"})
        out = figures.counted(labels.locked_labels_stream(votes), "labels", {"locked": F.col("label") != "unknown"})
        q = out.writeStream.format("memory").queryName("figured").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(300)
        for _ in range(100):
            if seen.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    found = spark.table("figured").toPandas()
    assert seen.counters["labels"] == {"rows": len(found), "locked": int((found.label != "unknown").sum())}
    assert seen.counters["votes"] == {"rows": 60, "left": 45}
    assert seen.latency()["count"] == 3 and 0 < seen.latency()["median"] <= seen.latency()["max"] and list(seen.ended.values()) == [None]
    assert seen.latency("nothing") == {}

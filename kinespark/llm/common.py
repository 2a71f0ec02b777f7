"""Small pieces that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed and
#: carriage return. Java and DuckDB (RE2) read the pattern alike.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session. A session on one machine that names none gets a
    folder in /tmp; on a cluster that is an error, as executors and driver would not share it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession) -> str:
    """This application's folder of written tables. Results read from it, so it stays until the
    application's owner is done with them and calls clear()."""
    return f"{checkpoint_dir(spark)}/kinespark-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has stored. DataFrames of the operators that have not been
    written elsewhere can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint; for small tables and loops."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, so that several later
    branches read it instead of computing it again."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """All words of a text, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_keys(*columns: str) -> list[Column]:
    """Two 64-bit hashes that name a row by its content. Rows that agree in all these columns
    share them, and so share whatever is decided for them."""
    cols = [F.col(c) for c in columns]
    null_pattern = F.concat_ws("", *[F.when(c.isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(null_pattern, *cols).alias("k1"), F.xxhash64(F.lit(7), null_pattern, *cols[::-1]).alias("k2")]


def unit(*cols) -> Column:
    """A double in [0, 1) that depends only on the columns: 53 bits of their hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def numbered_copies(df: DataFrame, run: int = 4096) -> DataFrame:
    """df with `copy`, a row's number among the rows equal to it, from 0. Equal rows are counted
    and made again in runs by different tasks, so that no task gathers them."""
    names = df.columns
    kinds = df.groupBy(*names).agg(F.count("*").alias("__n"))
    runs = kinds.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / run))))
    last = F.least(F.col("__n"), (F.col("__run") + 1) * run) - 1
    return runs.repartition(*names, "__run").select(*names, F.explode(F.sequence(F.col("__run") * run, last)).alias("copy"))

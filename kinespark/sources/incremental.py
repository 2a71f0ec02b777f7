"""Runs that skip what is done: outputs of new inputs are added to a table, all of a run or none.

A table is a folder. A run writes its rows to `run-<id>` and the keys it worked on to
`_pending/<id>`; one rename to `_keys/<id>` commits both. Readers take the runs that have keys, so
what a killed run leaves is never seen. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    """(file system, path, class of paths) of any store that Spark writes to."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = kind(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, kind


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The ids of the runs that are whole."""
    return _names(spark, f"{folder}/_keys")


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all whole runs; none before the first."""
    runs = committed(spark, folder)
    reader = spark.read.schema(schema)
    return reader.parquet(*[f"{folder}/run-{r}" for r in runs]) if runs else spark.createDataFrame([], schema)


def missing(inputs: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The inputs whose keys no whole run has worked on; null keys are keys."""
    spark = inputs.sparkSession
    runs = committed(spark, folder)
    if not runs:
        return inputs
    done = spark.read.schema(inputs.select(*keys).schema).parquet(*[f"{folder}/_keys/{r}" for r in runs])
    same = None
    for k in keys:
        here = inputs[k].eqNullSafe(done[k])
        same = here if same is None else same & here
    return inputs.join(done, same, "left_anti")


def add_missing(inputs: DataFrame, made: Callable[[DataFrame], DataFrame], folder: str, keys: list[str]) -> int:
    """Work on the inputs whose keys aren't done yet and add the rows; the number of keys worked
    on. Nothing is written where there are none. Inputs with several rows a key are worked on
    together; keys whose rows give no output are done too. The inputs must not change while a run
    reads them."""
    spark = inputs.sparkSession
    run = uuid.uuid4().hex
    fresh = missing(inputs, folder, keys)
    fresh.select(*keys).distinct().write.parquet(f"{folder}/_pending/{run}")
    fixed = spark.read.parquet(f"{folder}/_pending/{run}")
    n = fixed.count()
    fs, pending, kind = _fs(spark, f"{folder}/_pending/{run}")
    if not n:
        fs.delete(pending, True)
        return 0
    made(fresh).write.parquet(f"{folder}/run-{run}")
    fs.mkdirs(kind(f"{folder}/_keys"))
    if not fs.rename(pending, kind(f"{folder}/_keys/{run}")):
        raise OSError(f"run {run} could not be committed to {folder}")
    return n


def clean(spark: SparkSession, folder: str) -> list[str]:
    """Delete what killed runs have left, while none is running; their ids."""
    whole = set(committed(spark, folder))
    left = {n.removeprefix("run-") for n in _names(spark, folder) if n.startswith("run-")} - whole | set(_names(spark, f"{folder}/_pending"))
    for run in left:
        for path in (f"{folder}/run-{run}", f"{folder}/_pending/{run}"):
            fs, at, _ = _fs(spark, path)
            fs.delete(at, True)
    return sorted(left)

"""Lines with their places: numbered lines of files that are read in many splits, and files that
grow while they are followed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range of a followed file that one task reads, and of a look for its last line feed.
RANGE, LOOK = 64_000_000, 1 << 16


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, position, value): the lines of text files that aren't blank, numbered within
    their file: `line` from 1 over all lines, `position` from 0 over those that aren't blank.

    A file is read in splits by many tasks. Each split's lines are counted first, sums over the
    splits before give where a split starts, and a line is numbered from there: one row for each
    split is shuffled, never the lines.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    every = spark.read.text(path).select("value", *block).withColumn("id", F.monotonically_increasing_id())
    some = every.where(F.trim("value") != "").withColumn("some", F.monotonically_increasing_id())
    # a split is in one partition, whose ids rise by one from row to row
    of_all = every.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    of_some = some.groupBy("file", "block").agg(F.min("some").alias("first_some"), F.count("*").alias("n_some"))
    splits = of_all.join(of_some, ["file", "block"], "left")
    # a file has few splits: a terabyte in splits of 128 MB has some 8,000
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("n", "n_some")]
    starts = splits.select("file", "block", "first", "first_some", *before)
    placed = some.join(starts, ["file", "block"])
    return placed.select("file", (F.col("before_n") + F.col("id") - F.col("first") + 1).alias("line"), (F.col("before_n_some") + F.col("some") - F.col("first_some")).alias("position"), "value")


def parsed(lines: DataFrame, schema: str, place: Column) -> DataFrame:
    """lines (value) as records beside their other columns; a malformed one is an error that names
    its place."""
    broken = F.raise_error(F.concat_ws(" ", F.lit("Invalid JSON at"), place, F.substring("value", 1, 200)))
    whole = F.from_json("value", f"{schema}, __broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"})
    found = lines.withColumn("__r", whole).withColumn("__r", F.when(F.col("__r.__broken").isNull(), F.col("__r")).otherwise(broken))
    return found.select(*[c for c in lines.columns if c != "value"], "__r.*").drop("__broken")


def read_numbered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict scan of JSON lines with `file`, `line` and `position`; a malformed line is an error
    that names file:line."""
    return parsed(numbered_lines(spark, path), schema, F.concat_ws(":", "file", "line"))


def strided(records: DataFrame, stride: int, first: int | None = None, kind: str | None = None) -> DataFrame:
    """Records (position, type) of a kind at every `stride`-th place of their file, the first
    `first` of all by file and position. Places count every record, those of other kinds too."""
    kept = records.where((F.col("type") == kind) if kind else F.lit(True)).where(F.col("position") % stride == 0)
    return kept.orderBy("file", "position").limit(first) if first is not None else kept


@dataclass
class _Range(InputPartition):
    file: str
    low: int
    high: int
    start: int


class _Follower(DataSourceStreamReader):
    """The offset is a map of file to the byte after its last whole line."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.known: dict[str, int] = {}

    def _files(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=False))
        return system, sorted((f for f in found if f.is_file and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, files = self._files()
        for f in files:
            low, high = self.known.get(f.path, 0), f.size
            if high < low:
                raise ValueError(f"{f.path} has become shorter than what was read of it")
            with system.open_input_file(f.path) as data:
                while high > low:  # from the end back to the last line feed
                    start = max(low, high - LOOK)
                    at = data.read_at(high - start, start).rfind(b"\n")
                    if at >= 0:
                        self.known[f.path] = start + at + 1
                        break
                    high = start
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for file, high in sorted(end.items()):
            low = start.get(file, 0)
            self.known[file] = max(self.known.get(file, 0), high)
            out += [_Range(file, a, min(a + RANGE, high), low) for a in range(low, high, RANGE)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if partition.high <= partition.low:
            return
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder or self.folder.startswith("file:") else fs.LocalFileSystem()
        with system.open_input_file(partition.file) as data:
            at = partition.low
            data.seek(at if at == partition.start else at - 1)
            rest = b"" if at == partition.start else None  # a range takes the lines that start in it
            if rest is None:
                at -= 1
            while True:
                block = data.read(LOOK)
                done = not block
                if rest is None:
                    skip = block.find(b"\n")
                    if skip < 0 and not done:
                        at += len(block)
                        continue
                    at, block, rest = at + skip + 1, block[skip + 1 :], b""
                whole = rest + block
                *lines, rest = whole.split(b"\n")
                for line in lines:
                    if at >= partition.high:
                        return
                    if line.strip():
                        yield partition.file, at, line.decode()
                    at += len(line) + 1
                if done or at >= partition.high:
                    return


class FollowingLines(DataSource):
    """Streaming source of the files of a folder that others append lines to: (file, byte, value).
    Only lines that end in a line feed are given; what a writer has half written comes when it is
    whole. Files may appear late; one that gets shorter is an error. Options: path (a folder of
    any store that Arrow reads), suffix (.jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "following_lines"

    def schema(self) -> str:
        return "file string, byte long, value string"

    def streamReader(self, schema) -> _Follower:
        return _Follower(dict(self.options))


def following_jsonl(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of the JSON lines that are appended to a folder's files, with `file` and `byte`."""
    spark.dataSource.register(FollowingLines)
    return parsed(spark.readStream.format("following_lines").load(folder), schema, F.concat_ws(":", "file", F.concat(F.lit("byte "), "byte")))

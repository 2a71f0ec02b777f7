"""Conflict-constrained best-fit packing of documents into bins of equal capacity.

Documents are cut into pieces of at most `capacity` words. Pieces are dealt by hash to packing
groups of bounded expected size, each packed by itself in one task, largest piece first. A
group keeps, for every residual capacity, a bitmap of its open bins, and for every source and
every duplicate cluster a bitmap of the bins that hold it. A piece looks at the residuals from
its own size upwards, successor by successor, until one has a bin free of its source and its
cluster: that is the tightest compatible bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, n_words, numbered_copies, row_keys

#: Pieces that a packing group holds on average.
GROUP_PIECES = 4096


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, given in the order of packing; sizes are 1 to capacity."""
    level = [0] * (capacity + 1)  # bins by residual, as bitmaps
    used = 0  # residuals that have a bin
    by_source: dict = {}
    by_cluster: dict = {}
    room: list[int] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        clash = by_source.get(source, 0) | by_cluster.get(cluster, 0)
        rest, bit = used >> size, 0
        residual = size - 1
        while rest:
            step = (rest & -rest).bit_length()
            residual += step
            rest >>= step
            free = level[residual] & ~clash
            if free:
                bit = free & -free
                break
        if bit:
            at = bit.bit_length() - 1
            level[residual] ^= bit
            if not level[residual]:
                used &= ~(1 << residual)
        else:
            at = len(room)
            room.append(capacity)
            bit, residual = 1 << at, capacity
        placed.append((at, capacity - residual))
        room[at] = residual - size
        if room[at]:
            level[room[at]] |= bit
            used |= 1 << room[at]
        by_source[source] = by_source.get(source, 0) | bit
        by_cluster[cluster] = by_cluster.get(cluster, 0) | bit
    return placed


OUT = "doc_id long, k1 long, k2 long, copy long, piece long, source string, bin_id string, bin_offset long, n_words long"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _pack(capacity: int):
    def packed(group: list[dict]) -> pa.RecordBatch:
        group.sort(key=lambda r: (-r["size"], r["lot"]))
        bins = best_fit([r["size"] for r in group], [r["source"] for r in group], [r["cluster"] for r in group], capacity)
        kinds = {c: pa.string() if c == "source" else pa.int64() for c in ("doc_id", "k1", "k2", "copy", "piece", "source")}
        own = [pa.array([r[c] for r in group], kind) for c, kind in kinds.items()]
        bin_ids = pa.array([f"{group[0]['g']:x}-{b:x}" for b, _ in bins])
        return pa.RecordBatch.from_arrays([*own, bin_ids, pa.array([o for _, o in bins], pa.int64()), pa.array([r["size"] for r in group], pa.int64())], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and row["g"] != group[0]["g"]:
                    yield packed(group)
                    group = []
                group.append(row)
        if group:
            yield packed(group)

    return run


def dealt_pieces(docs: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES, cluster: str | None = None) -> tuple[DataFrame, int]:
    """The pieces to pack, with their group `g` and their order `lot` among equal sizes, and the
    number of groups; pieces without words have size 0."""
    rows = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("n"),
        (F.col(cluster) if cluster else F.xxhash64("text")).cast("long").alias("cluster"),
        *row_keys("doc_id", "source", "text"),
    )
    pieces = cut(
        numbered_copies(rows)
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / capacity)))))
        .withColumn("size", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long"))
    )
    groups = max(1, -(-pieces.where("size > 0").count() // group_pieces))
    lot = F.xxhash64("k1", "k2", "piece", "copy")
    return pieces.withColumn("lot", lot).withColumn("g", F.pmod("lot", F.lit(groups))), groups


def pack(docs: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES, cluster: str | None = None) -> DataFrame:
    """Rows (doc_id, k1, k2, copy, piece, source, bin_id, bin_offset, n_words): every word of
    every document in one bin, no bin over `capacity` words, and no bin with two pieces of one
    source or of one duplicate cluster: documents with the same value of the integer column
    `cluster`, such as near_dedup's component_id, or with equal texts where none is named. A
    document's own pieces are of one cluster.

    k1 and k2 are hashes of doc_id, source and text, copy numbers the rows alike in these, and
    piece p covers words from p * capacity on, so packed_texts() can rebuild every bin. A
    document without words (null or blank text) has one row with bin_id and bin_offset null and
    n_words 0. A null source is a source of its own, a null cluster a cluster. Repeated rows are
    packed each. Equal inputs give equal bins; ties go to the bin opened first. Other columns
    are ignored. The number of groups follows the number of pieces, so a group's memory doesn't
    grow with the table, and neither a hot source nor a large cluster nor rows repeated exactly
    gather in one group.
    """
    pieces, groups = dealt_pieces(docs, capacity, group_pieces, cluster)
    slices = min(groups, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 16))
    packed = (
        pieces.where("size > 0")
        .select("g", "doc_id", "k1", "k2", "copy", "piece", "source", "cluster", "size", "lot")
        .repartition(slices, "g")
        .sortWithinPartitions("g", "lot", "k1", "copy", "piece")
        .mapInArrow(_pack(capacity), OUT)
    )
    nowhere = [F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("bin_offset"), F.lit(0).cast("long").alias("n_words")]
    return packed.unionByName(pieces.where("size <= 0").select("doc_id", "k1", "k2", "copy", "piece", "source", *nowhere))


def packed_texts(docs: DataFrame, packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Rows (bin_id, n_words, text): each bin's words, in order of their offsets and parted by
    single spaces. `docs` is the table that was packed, repeated ids and rows included; a bin
    holds at most `capacity` words, which bounds what one task gathers."""
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    texts = docs.select(*row_keys("doc_id", "source", "text"), "text").dropDuplicates(["k1", "k2"])
    spans = packed.where("bin_id is not null").select("k1", "k2", "bin_id", "bin_offset", "n_words", "piece")
    one = spans.join(texts, ["k1", "k2"]).select(
        "bin_id", "n_words", F.struct("bin_offset", F.array_join(F.slice(found, (F.col("piece") * capacity + 1).cast("int"), F.col("n_words").cast("int")), " ").alias("words")).alias("part")
    )
    return one.groupBy("bin_id").agg(F.sum("n_words").alias("n_words"), F.sort_array(F.collect_list("part")).alias("parts")).select(
        "bin_id", "n_words", F.array_join(F.col("parts.words"), " ").alias("text")
    )

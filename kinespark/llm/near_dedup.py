"""Near-duplicate documents by min-max hashing, with every link confirmed on full sets.

Signature: for each permutation both the least and the greatest image of the shingle set are
kept, so P permutations give 2 P nearly independent values, each of which two sets share with
probability equal to their Jaccard similarity. Bands of `rows` values are the bucket keys.

Sets that are equal form one class, and all later work is on classes, so a large group of
copies costs one row. A bucket with several classes is searched exactly: its classes are
dealt to blocks of bounded size, and each pair of blocks is one piece of work that computes
all true similarities inside numpy and returns only a spanning forest of the links. Buckets
with the same members in several bands are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_keys, stored
from .components import connected_components

#: Classes and shingles in one block of a bucket.
BLOCK_CLASSES, BLOCK_SHINGLES = 384, 400_000


class _WordHash(dict):
    """64-bit hash of each word, remembered for up to `limit` words."""

    limit = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, width: int, seen: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text. Words are runs without
    ASCII white space, A-Z in lower case. A text with fewer words than `width` has its whole
    word sequence as its only shingle; without words it has none."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))
    k = min(width, len(h))
    factor = _odd(width, 11)
    with np.errstate(over="ignore"):
        total = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            total += h[i : len(h) - k + 1 + i] * factor[i]
        return np.unique(_mixed(total))


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket key of each band of the min-max signature of a non-empty set."""
    n = -(-bands * rows // 2)
    flip, factor = _odd(n, 23)[:, None], _odd(n, 29)[:, None]
    low, high = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            image = (shingles[None, at : at + 2048] ^ flip) * factor
            np.minimum(low, image.min(axis=1), out=low)
            np.maximum(high, image.max(axis=1), out=high)
        signature = np.stack([low, high], axis=1).ravel()[: bands * rows].reshape(bands, rows)
        return _mixed((_mixed(signature) * _odd(rows, 31)).sum(axis=1, dtype=np.uint64) + _odd(bands, 37))


def _sign(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _WordHash()
        for batch in batches:
            sizes, classes, keys = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                own = shingle_set(text.as_py(), width, seen)
                sizes.append(len(own))
                classes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                keys.append(band_keys(own, bands, rows).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "k1", "k2", "n_shingles", "class", "keys"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [shingle_set(t.as_py(), width, seen).tobytes() for t in part.column("text").cast(pa.binary())]
                classes = [xxhash.xxh3_128_digest(x) for x in own]
                right = pa.array([a == b.as_py() for a, b in zip(classes, part.column("class"), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(own, pa.binary())], ["class", "shingles"]).filter(right)

    return run


def _links_between(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Boolean matrix of 100 * intersection >= percent * union; right is left where None."""
    both = left if right is None else left + right
    size = np.array([len(x) for x in both], np.int64)
    _, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), size)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n, k = len(left), len(both)
    common = np.zeros((n, n if right is None else k - n), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        member = np.zeros((k, 4096), np.float32)
        member[row[a:b], column[a:b] - start] = 1
        common += member[:n] @ (member if right is None else member[n:]).T
    common = common.astype(np.int64)
    union = size[:n, None] + (size[None, :n] if right is None else size[None, n:]) - common
    return 100 * common >= percent * union


def _forest(links: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """(node, root) for the nodes of a link matrix that aren't their component's least."""
    n, m = links.shape
    label = np.arange(n if square else n + m)
    while True:
        was = label.copy()
        if square:
            np.minimum(label, np.where(links, label[None, :], len(label)).min(axis=1, initial=len(label)), out=label)
        else:
            top, low = label[:n], label[n:]
            np.minimum(top, np.where(links, low[None, :], len(label)).min(axis=1, initial=len(label)), out=top)
            np.minimum(low, np.where(links, top[:, None], len(label)).min(axis=0, initial=len(label)), out=low)
        label = label[label]
        if (label == was).all():
            return [(i, int(j)) for i, j in enumerate(label) if i != j]


def _confirm(percent: int):
    def edges(group: list[tuple[bytes, int, bytes]], lo: int, hi: int) -> list[tuple[bytes, bytes]]:
        first = [x for x in group if x[1] == lo]
        second = [x for x in group if x[1] != lo]
        if lo == hi:
            sets = [np.frombuffer(x[2], np.uint64) for x in first]
            if len(sets) == 2:
                common = len(np.intersect1d(*sets, assume_unique=True))
                found = [(1, 0)] if 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common) else []
            else:
                found = _forest(_links_between(sets, None, percent), True) if sets else []
            names = first
        else:
            if not first or not second:
                return []
            sets = [[np.frombuffer(x[2], np.uint64) for x in side] for side in (first, second)]
            found = _forest(_links_between(*sets, percent), False)
            names = first + second
        return [(names[i][0], names[j][0]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "lo", "hi", "class", "block")]
            shingles = batch.column("shingles")
            for at, (bucket, lo, hi, name, block) in enumerate(zip(*columns, strict=True)):
                if (bucket, lo, hi) != now:
                    if now:
                        out += edges(group, *now[1:])
                    now, group = (bucket, lo, hi), []
                group.append((name, block, shingles[at].as_py()))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if now:
            out += edges(group, *now[1:])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _order() -> Column:
    """The total order of rows by which a component has one first: doc_id, null last, then content."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "k1", "k2")


def _components(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(signed, final): each row of `docs` with its keys and its class (null for an empty set), and
    each class with its component's smallest id and first row by _order()."""
    signed = stored(
        docs.select("doc_id", *row_keys("doc_id", "text"), "text").mapInArrow(
            _sign(width, bands, rows), "doc_id long, k1 long, k2 long, n_shingles long, class binary, keys array<long>"
        )
    )
    classes = stored(
        signed.where("class is not null")
        .groupBy("class")
        .agg(F.min("doc_id").alias("least_id"), F.min("n_shingles").alias("n"), F.first("keys").alias("keys"), F.min_by(F.struct("k1", "k2"), F.struct("k1", "k2")).alias("at"), F.min(_order()).alias("first"))
    )
    keyed = classes.select("class", "n", F.explode("keys").alias("bucket"))
    shape = keyed.groupBy("bucket").agg(
        F.count("*").alias("m"), F.sum("n").alias("mass"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64(F.lit(5), "class")).alias("y")
    )
    chosen = shape.where("m > 1").groupBy("m", "mass", "x", "y").agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_CLASSES, F.col("mass") / BLOCK_SHINGLES)).cast("int")
    members = stored(
        keyed.select("class", "bucket")
        .join(chosen.select("bucket", blocks.alias("blocks")), "bucket")
        .select("bucket", "class", "blocks", F.pmod(F.xxhash64(F.lit(3), "class"), F.col("blocks")).cast("int").alias("block"))
    )
    wanted = classes.join(members.select("class").distinct(), "class", "left_semi").select("class", "at.k1", "at.k2")
    sets = docs.select(*row_keys("doc_id", "text"), "text").join(wanted, ["k1", "k2"]).select("class", "text").mapInArrow(_sets(width), "class binary, shingles binary")
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "class", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    work = pairs.join(sets, "class").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "class")
    edges = work.select("bucket", "lo", "hi", "class", "block", "shingles").mapInArrow(_confirm(percent), "a binary, b binary")
    labels = connected_components(edges)
    least = classes.select("class", "least_id", "first")
    joined = labels.join(least, F.col("node") == F.col("class"))
    roots = joined.groupBy("label").agg(F.min("least_id").alias("root_id"), F.min("first").alias("root_first"))
    moved = joined.join(roots, "label").select(F.col("node").alias("class"), "root_id", "root_first", F.lit(True).alias("linked"))
    final = least.join(moved, "class", "left").select(
        "class", F.when(F.col("linked"), F.col("root_id")).otherwise(F.col("least_id")).alias("root_id"), F.coalesce("root_first", "first").alias("first")
    )
    return signed, final


def _verdicts(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = 20, rows: int = 5) -> DataFrame:
    """near_duplicates() with `first`: whether the row is the first of its component."""
    signed, final = _components(docs, width, percent, bands, rows)
    # written, so that both sides of the join are plain shuffles, of which AQE splits a hot class
    final = stored(final)
    # an empty set is the first of its own component
    is_first = F.coalesce(_order() == F.col("first"), F.lit(True))
    alone = F.col("doc_id").isNull() & F.col("root_id").isNull() & F.col("first")
    return (
        signed.drop("keys")
        .join(final, "class", "left")
        .select("doc_id", "k1", "k2", "n_shingles", F.coalesce("root_id", "doc_id").alias("component_id"), is_first.alias("first"))
        .withColumn("root_id", F.col("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), alone))
        .drop("root_id")
    )


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, bands: int = 20, rows: int = 5) -> DataFrame:
    """Rows (doc_id, k1, k2, n_shingles, component_id, kept), one for each row of `docs`.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable. A pair at the threshold meets in no band
    with probability (1 - (percent / 100) ** rows) ** bands: 8e-6 at the defaults, less for
    closer pairs. Links among the members of a bucket are decided on full sets, without caps.

    Null or blank text: an empty set, linked with nothing, its own component, kept. Rows that
    repeat a doc_id keep a row each. A null doc_id takes part; it gets the component_id of its
    group (null if the group has no other id) and kept false; in a group without ids the first by
    k1 and k2 is kept.
    Other columns are ignored. k1 and k2 are hashes of (doc_id, text).
    """
    return _verdicts(docs, width, percent, bands, rows).drop("first")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """The rows of `docs` with one document left of each group of near duplicates, that with
    the smallest doc_id (null last, then by content). Rows alike in doc_id and text count as one group and leave one row.
    All columns are returned as they came, whatever their names."""
    # a component names its first row, so documents need not meet their classes
    signed, final = _components(docs, width, percent, bands, rows)
    verdict = final.select("first.k1", "first.k2").unionByName(signed.where("class is null").select("k1", "k2")).distinct()
    keys = dict(zip(("__k1", "__k2"), row_keys("doc_id", "text"), strict=True))
    rank = F.row_number().over(Window.partitionBy("__k1", "__k2").orderBy("__k1"))
    kept = docs.withColumns(keys).join(verdict.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")), ["__k1", "__k2"])
    return kept.withColumn("__rank", rank).where("__rank = 1").select(*[F.col(f"`{c}`") for c in docs.columns])

"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one of each codebook. The
codebooks are fitted on a bounded sample, each to what the ones before leave; a beam search
picks the codewords of every vector. A query's inner products with all codewords make a lookup
table, a candidate's score is the sum of its codewords' entries, scaled by its stored norm, and
the best over all blocks of candidates are scored again exactly on their original vectors.

Equal vectors are one candidate. Blocks of codes stay where they are while packed queries stream
past them; only ids and scores of the best leave a block, and original vectors move only for
these, by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Vectors of the sample on which the codebooks are fitted, at most.
SAMPLE = 8192
#: Codebooks, codewords of each, beams, and rounds of fitting.
BOOKS, WORDS, BEAMS, ROUNDS = 32, 64, 4, 6
#: Vectors packed in a row of queries, candidates of a block, and candidates scored again.
QUERIES, CANDIDATES, AGAIN = 64, 65_536, 1000


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Codebooks (books, words, dimensions) by k-means on the residuals; fewer words if the
    sample has fewer vectors."""
    random = np.random.default_rng(seed)
    rest, words = sample.astype(np.float32).copy(), min(words, max(1, len(sample)))
    out = []
    for _ in range(books):
        own = rest[random.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            code = (rest @ own.T - 0.5 * (own**2).sum(1)).argmax(1)
            order = np.argsort(code, kind="stable")
            at, starts, n = np.unique(code[order], return_index=True, return_counts=True)
            own[at] = np.add.reduceat(rest[order], starts, axis=0) / n[:, None]
        out.append(own)
        rest -= own[(rest @ own.T - 0.5 * (own**2).sum(1)).argmax(1)]
    return np.stack(out)


def encode(vectors: np.ndarray, books: np.ndarray, beams: int = BEAMS) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scale): a codeword of each book per vector by beam search, and the factor that
    gives the sum of the codewords the norm of the vector."""
    x = vectors.astype(np.float32)
    n, (m, k, d) = len(x), books.shape
    rest, codes, error = x[:, None, :], np.zeros((n, 1, 0), np.uint8), (x**2).sum(1)[:, None]
    for book in books:
        cost = error[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, -1, k) + (book**2).sum(1)
        flat = cost.reshape(n, -1)
        b = min(beams, flat.shape[1])
        best = np.argpartition(flat, b - 1, axis=1)[:, :b]
        beam, word = best // k, best % k
        rows = np.arange(n)[:, None]
        rest, error = rest[rows, beam] - book[word], flat[rows, best]
        codes = np.concatenate([codes[rows, beam], word[:, :, None].astype(np.uint8)], axis=2)
    pick = error.argmin(1)
    close = x - rest[np.arange(n), pick]
    size = np.linalg.norm(close, axis=1)
    return codes[np.arange(n), pick], np.where(size > 0, np.linalg.norm(x, axis=1) / np.maximum(size, 1e-30), 0).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _coded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                codes, scale = encode(_matrix(part.column("x")), books)
                code = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("c"), part.column("block"), code, pa.array(scale)], ["c", "block", "code", "scale"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, QUERIES):
            part = batch.slice(at, QUERIES)
            x = np.ascontiguousarray(_matrix(part.column("x")), np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part.column("q").to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["q_ids", "q_x"])


FOUND = "q long, best array<struct<near:float,c:long>>"


def _scored(books: np.ndarray, keep: int):
    m, k, d = books.shape

    def nearest(q: np.ndarray, codes: np.ndarray, scale: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = np.einsum("qd,mkd->mqk", q, books, optimize=True)
        near = np.zeros((len(q), len(ids)), np.float32)
        for j in range(m):
            near += table[j][:, codes[:, j]]
        near *= scale
        n = min(keep, len(ids))
        at = np.argpartition(near, len(ids) - n, axis=1)[:, len(ids) - n :]
        return np.take_along_axis(near, at, axis=1), ids[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, part, held = None, [], None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("block", "lane")), batch.column("q_ids").is_null().to_pylist(), strict=True))
            at = 0
            for (block, lane, candidate), run_of in groupby(places):
                rows = batch.slice(at, n := sum(1 for _ in run_of))
                at += n
                if (block, lane) != here:
                    here, part, held = (block, lane), [], None
                if candidate:
                    part.append(rows)
                    continue
                if held is None and part:  # the block is complete, as its candidates come first
                    code = b"".join(x for r in part for x in r.column("code").to_pylist())
                    scale, ids = (np.concatenate([r.column(c).to_numpy() for r in part]) for c in ("scale", "c"))
                    held, part = (np.frombuffer(code, np.uint8).reshape(-1, m), scale, ids), []
                if held is None:
                    continue
                for q_ids, q_x in zip(rows.column("q_ids").to_pylist(), rows.column("q_x").to_pylist(), strict=True):
                    near, c = nearest(np.frombuffer(q_x, np.float32).reshape(-1, d), *held)
                    best = pa.StructArray.from_arrays([pa.array(near.ravel()), pa.array(c.ravel())], ["near", "c"])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), best)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q_ids, np.int64)), lists], ["q", "best"])

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = (_matrix(batch.column("x")).astype(np.float64) * _matrix(batch.column("q_x")).astype(np.float64)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("q", "query_id", "ids")] + [pa.array(score)], ["q", "query_id", "ids", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part: with an id, of the table's most common length
    (the longer of two), all components finite, not all zero. x is an array of floats if the
    column is, else of doubles, so no component is rounded."""
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) or vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), False)
    x = F.col("embedding").cast("array<float>" if single else "array<double>")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    found = vectors.where(good).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    lengths = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.where(F.size("x") == (lengths["d"] if lengths else 0))


def _unit(x: Column, largest: float) -> Column:
    """x divided by a power of two so that single precision holds it; used for codes only."""
    scale = float(2.0 ** max(0, int(np.ceil(np.log2(largest))) - 60)) if largest > 0 else 1.0
    return F.transform(x, lambda v: (v / F.lit(scale)).cast("float"))


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, again: int = AGAIN) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row of `queries` the `top` rows of
    `vectors` (both: vec_id, embedding) found nearest, those with its own vec_id left out.

    Nearest is the largest inner product, in double precision on the original vectors; ties go
    to the smaller vec_id. Vectors that are null, zero, of an odd length or not finite take no
    part. Every vector is coded; only the codebooks come from a sample, of SAMPLE vectors at
    most. The best `again` distinct vectors over all blocks are scored exactly. A distinct vector
    stands for all its rows and comes back with the smallest of their ids, so a large group of
    copies takes one place. Rows that repeat a vec_id are candidates of their own; a query that
    comes twice has an answer each. Other columns are ignored; without usable vectors or queries
    there are no rows.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = stored(usable(vectors).withColumns({"x1": F.xxhash64("x"), "x2": F.xxhash64(F.lit(1), "x")}))
    # distinct vectors, each with its smallest ids: `top` and the query's own, repeated ids counted
    same = ["x1", "x2"]
    ids = base.groupBy(*same, "vec_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*same).orderBy("vec_id")
    ids = ids.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= top + 1).groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("vec_id", F.least("n", F.lit(top)).alias("n")))).alias("ids"))
    kinds = base.groupBy(*same).agg(F.first("x").alias("x")).join(ids, same)
    kinds = stored(kinds.select("x1", "x", "ids").withColumn("c", F.monotonically_increasing_id()))
    total = kinds.count()
    asked = stored(usable(queries).withColumn("q", F.monotonically_increasing_id()))
    n_asked = asked.count()
    if not total or not n_asked:
        return nothing
    width, asked_width = (df.select(F.size("x")).first()[0] for df in (kinds, asked))
    if width != asked_width:
        return nothing
    largest = max(df.agg(F.max(F.array_max(F.transform("x", F.abs)).cast("double"))).first()[0] for df in (kinds, asked))
    coarse = _unit(F.col("x"), largest)
    sample = kinds.orderBy("x1", "c").limit(SAMPLE).select(coarse.alias("x")).toArrow()
    books = fit(_matrix(sample.column("x").combine_chunks()))
    blocks = -(-total // CANDIDATES)
    coded = kinds.select("c", F.pmod("x1", F.lit(blocks)).cast("int").alias("block"), coarse.alias("x")).mapInArrow(_coded(books), "c long, block int, code binary, scale float")
    packed = asked.select("q", coarse.alias("x")).mapInArrow(_packed, "q_ids binary, q_x binary")
    # each block is laid out `lanes` times, so that few blocks occupy all tasks; a pack of queries passes one lane
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(1, min(n // blocks, -(-n_asked // QUERIES)))
    place = stored(coded).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).select("block", "lane", "c", "code", "scale", F.lit(None).cast("binary").alias("q_ids"), F.lit(None).cast("binary").alias("q_x"))
    passing = packed.withColumn("lane", F.pmod(F.xxhash64("q_ids"), F.lit(lanes)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    passing = passing.select("block", "lane", F.lit(None).cast("long").alias("c"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("scale"), "q_ids", "q_x")
    lined = place.unionByName(passing).repartition(n, "block", "lane").sortWithinPartitions("block", "lane", F.col("q_ids").isNotNull())
    # distinct vectors are dealt by hash, so a block has about again / blocks of the best; six standard deviations more are kept
    keep = min(again, int(again / blocks + 6 * (again / blocks) ** 0.5) + 8)
    found = lined.mapInArrow(_scored(books, keep), FOUND)
    # of a query's best in each block, about twice `again` in all, the best
    best = found.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, again).alias("best")).select("q", F.explode("best.c").alias("c"))
    pairs = best.join(kinds.select("c", "x", "ids"), "c").join(asked.select("q", F.col("vec_id").alias("query_id"), F.col("x").alias("q_x")), "q")
    scored = pairs.select("q", "query_id", "ids", "x", "q_x").mapInArrow(_exact, "q long, query_id long, ids array<struct<vec_id:long,n:long>>, score double")
    others = F.filter("ids", lambda e: e.vec_id != F.col("query_id"))
    rows = scored.select("q", "query_id", "score", F.explode(others).alias("e")).select("q", "query_id", "score", "e.vec_id", F.explode(F.array_repeat(F.lit(0), F.col("e.n").cast("int"))))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")

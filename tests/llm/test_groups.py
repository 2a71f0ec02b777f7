"""Large groups of equal or near rows in the training-data operators."""

from collections import Counter

import numpy as np

from kinespark.llm import ann, near_dedup, packing


def test_repeated_rows_spread(spark):
    """Equal rows go to many packing groups, each with a bin of its own."""
    docs = [(7, "a b c", "s")] * 3000 + [(100 + i, f"w{i} x", f"t{i % 5}") for i in range(1000)]
    found = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), 16, 100).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(d[0] for d in docs)
    assert len({r["bin_id"] for r in found if r["doc_id"] == 7}) == 3000
    assert max(Counter(r["bin_id"].split("-")[0] for r in found).values()) < 250


def test_copies_take_one_place(spark):
    """More copies than reranks, whose approximate score beats that of better vectors."""
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[:300] = x[0]
    q = (x[0] + 0.4 * r.normal(size=16)).astype(np.float32)
    x[300:600] = (x[300:600] * 0.2 + q * 1.3).astype(np.float32)
    schema = "vec_id long, embedding array<float>"
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], schema)
    asked = spark.createDataFrame([(10_000, q.tolist()), (3, x[3].tolist())], schema)
    got = {(row["query_id"], row["rank"]): row["vec_id"] for row in ann.search(v, asked, 8, 301).collect()}
    for name, y in ((10_000, q), (3, x[3])):
        exact = x.astype(float) @ y.astype(float)
        want = [i for i in np.lexsort((np.arange(600), -exact)) if i != name][:8]
        assert [got[name, k] for k in range(1, 9)] == want


def test_one_of_each_group_is_left(spark):
    """Near copies without ids, and near copies that share one id, leave one row."""
    base = [f"w{i}" for i in range(120)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (0, 119)]
    for ids in ([None, None, None], [5, 5, 5], [None, 4, 4]):
        docs = spark.createDataFrame([*zip(ids, [" ".join(base), *near], strict=True), (None, "alone " * 9), (9, None), (None, " ")], "doc_id long, text string")
        left = near_dedup.drop_near_duplicates(docs).collect()
        group = [r for r in left if r["text"] and "w60" in r["text"]]
        assert len(group) == 1 and len(left) == 4
        assert group[0]["doc_id"] == min((i for i in ids if i is not None), default=None)
        kept = [r["kept"] for r in near_dedup.near_duplicates(docs).collect() if r["n_shingles"] > 50]
        assert len(kept) == 3 and (kept.count(True) == 1 if ids[1] is None else any(kept))

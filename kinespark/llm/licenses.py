"""License scan: an exact set-similarity join of text blocks with license texts.

The tokens of a text are its runs of WIDTH words. A block meets a template if it holds at least
`percent` percent of the template's distinct tokens. Tokens are ordered by how often the corpus
has them, rarest first. With o tokens to share, the first |T| - o + 1 tokens of the template and
the first |B| - o + 1 of the block must have one in common (prefix filter), |B| must reach o
(length filter), and what follows the common token on either side must suffice for the rest
(positional filter). What passes is confirmed on full sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_keys, stored
from .license_texts import PHRASES, TEMPLATES

#: Words of a token: in order and next to each other, so that words which merely stand near
#: one another don't make a license.
WIDTH = 5
#: After A-Z became a-z: ASCII letters and digits and all that isn't ASCII.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall

SCANNED = "doc_id long, k1 long, k2 long, n_words long, n_base long, first_word long, last_word long, base array<string>, hits array<struct<at:int,token:int>>"


def words(text: bytes | None) -> list[bytes]:
    return _WORDS(text.lower()) if text else []


def tokens(found: list[bytes]) -> list[tuple[bytes, ...]]:
    """Runs of WIDTH words by their first word."""
    return [tuple(found[i : i + WIDTH]) for i in range(len(found) - WIDTH + 1)]


def _scan(vocabulary: dict[tuple[bytes, ...], int]):
    """Base phrases of each document, and where it has tokens of the vocabulary."""
    phrases: dict[bytes, list[tuple[str, list[bytes]]]] = {}
    for label, phrase in PHRASES:
        phrases.setdefault(phrase.encode().split()[0], []).append((label, phrase.encode().split()))
    pairs = {t[:2] for t in vocabulary}

    def places(found: list[bytes]) -> list[tuple[int, str]]:
        if phrases.keys().isdisjoint(found):
            return []
        return [(i, label) for i, w in enumerate(found) for label, phrase in phrases.get(w, ()) if found[i : i + len(phrase)] == phrase]

    def hits(found: list[bytes]) -> list[dict]:
        near = [i for i, pair in enumerate(zip(found, found[1:])) if pair in pairs]
        known = ((i, vocabulary.get(tuple(found[i : i + WIDTH]))) for i in near)
        return [{"at": i, "token": t} for i, t in known if t is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.struct([("at", pa.int32()), ("token", pa.int32())]))]
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column("text").cast(pa.binary()):
                found = words(text.as_py())
                base = places(found)
                at = [i for i, _ in base]
                rows.append((len(found), len(base), min(at, default=None), max(at, default=None), sorted({x for _, x in base}), hits(found)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "k1", "k2")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in SCANNED.split(", ")]
            )

    return run


def license_scan(docs: DataFrame, percent: int = 80, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one for
    each row of `docs`.

    Blocks are runs of 2 m words of the whole text at every m-th word, m being the length of the
    longest template, so that any m consecutive words lie in one block. labels are those of the
    base phrases and of every template that some block meets, unless another template met there
    shares all that it shares and more (the words that two licenses have in common count for the
    one whose own words are there too). score is the greatest containment of a template that
    gave a label, 1 if a base phrase is there, else 0.

    Null or empty text: no words, no labels (empty strings), score 0. Repeated rows keep a row
    each. The texts are read once; only the tokens of the templates are counted, and only their
    counts, as many as the templates have tokens, come to the driver. Ties in the order go by
    token. A template has WIDTH words at least. Other columns are ignored.
    """
    lists = [(label, words(text.encode())) for label, text in templates]
    if any(len(own) < WIDTH for _, own in lists):
        raise ValueError(f"a template has fewer than {WIDTH} words")
    sets = [(label, frozenset(tokens(own))) for label, own in lists]
    vocabulary = {t: i for i, t in enumerate(sorted(frozenset().union(*(s for _, s in sets))))}
    texts = docs.select("doc_id", *row_keys("doc_id", "text"), "text")
    scanned = stored(texts.mapInArrow(_scan(vocabulary), SCANNED))
    hits = scanned.where(F.size("hits") > 0).select("k1", "k2", F.explode("hits").alias("h")).select("k1", "k2", "h.at", "h.token")
    n = {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}
    rank = {t: i for i, t in enumerate(sorted(vocabulary.values(), key=lambda t: (n.get(t, 0), t)))}
    index = []
    for number, (label, own) in enumerate(sets):
        ordered = sorted(rank[vocabulary[t]] for t in own)
        share = -(-percent * len(ordered) // 100)
        index += [(r, number, label, i, len(ordered), share, ordered) for i, r in enumerate(ordered[: len(ordered) - share + 1])]
    spark = docs.sparkSession
    table = spark.createDataFrame(index, "rank int, template int, label string, i int, m int, share int, words array<int>")
    ranks = spark.createDataFrame(list(rank.items()), "token int, rank int")
    m = max(len(own) for _, own in lists)
    # the blocks b with b m <= at and at + WIDTH <= (b + 2) m
    last, first = F.floor(F.col("at") / m), F.greatest(F.lit(0), F.ceil((F.col("at") + WIDTH) / m) - 2)
    placed = hits.join(F.broadcast(ranks), "token").select("k1", "k2", "rank", F.explode(F.sequence(first, last)).alias("block"))
    # a block has at most the templates' tokens, however often it repeats them
    blocks = placed.groupBy("k1", "k2", "block").agg(F.array_sort(F.collect_set("rank")).alias("own")).withColumn("n", F.size("own"))
    probe = blocks.select("*", F.posexplode("own").alias("j", "rank"))
    passes = (F.col("n") >= F.col("share")) & (F.col("j") <= F.col("n") - F.col("share")) & (F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= F.col("share"))
    # the index has at most as many rows as the templates have tokens
    met = probe.join(F.broadcast(table), "rank").where(passes)
    met = met.withColumn("shared", F.array_sort(F.array_intersect("own", "words"))).where(F.size("shared") >= F.col("share"))
    one = F.struct("label", (F.size("shared") / F.col("m")).alias("part"), "shared")
    # a block meets each template once at most, so this gathers no more than there are templates
    by_block = met.groupBy("k1", "k2", "block").agg(F.collect_set(one).alias("met"))

    def outdone(x: Column, y: Column) -> Column:
        return (F.size(y.shared) > F.size(x.shared)) & (F.size(F.array_except(x.shared, y.shared)) == 0)

    best = F.filter("met", lambda x: ~F.exists("met", lambda y: outdone(x, y)))
    found = by_block.select("k1", "k2", F.explode(best).alias("x")).groupBy("k1", "k2").agg(F.collect_set("x.label").alias("found"), F.max("x.part").alias("met"))
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return scanned.drop("hits").join(found, ["k1", "k2"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("met", F.lit(0.0))).alias("score"),
    )

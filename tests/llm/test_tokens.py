"""Byte-level BPE, tokenizer alignment, whitening and exact mixing against the libraries and
brute-force versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from kinespark.llm import align, ann, bpe, mixing, queries, whitening
from tests.conftest import SF
from tests.llm.test_llm import documents, empty, hard, words  # noqa: F401

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "\n", "  a", "a  ", "a\n\nb", "a \n b\n\n c  \t d.", "a▁b", "<s> x </s><unk> <0x41>", "<|endoftext|>", "é🙂𝔘 x\x00ý", "don't can't.\nNo, it's", "x\n.\ny", "日本語。テスト\n\n次",
    " 　 b  ", "a\r\nb \r\n c", "....---  ===\n\n\n", "Ᲊ x\U00010d40 1", "\x85 a \x1c b", "x" * 1000 + " " + "y" * 300 + " z", "word" * 30_000,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS), special_tokens={})


def test_transducer_equals_merging(library):
    encoder, draw = bpe.Encoder(bpe.ranks(RANKS)), random.Random(1)
    tokens = list(bpe.ranks(RANKS))
    for k in range(6000):
        data = b"".join(draw.choice(tokens) for _ in range(draw.randint(1, 6))) if k % 2 else bytes(draw.choice(b"aab e\xc3\xa9 '") for _ in range(draw.randint(1, 20)))
        assert encoder.piece(data) == library._encode_single_piece(data), data
    assert encoder.waits <= max(map(len, tokens))
    # texts that recur run through the states alone
    again = [encoder.piece(b" the thing") for _ in range(40)]
    assert len(encoder.states) > 5 and all(a == library._encode_single_piece(b" the thing") for a in again)


@pytest.mark.parametrize("often", [0, 3, 10**9])
def test_transducer_of_any_vocabulary(monkeypatch, often):
    """Random merges over three letters, where borders and ties are common; states always, at
    times, and never made."""
    monkeypatch.setattr(bpe, "OFTEN", often)
    for seed in range(12):
        draw = random.Random(seed)
        vocabulary = {bytes([i]): i for i in range(256)}
        while len(vocabulary) < 300:
            a, b = (draw.choice([t for t in vocabulary if set(t) <= set(b"abc")]) for _ in range(2))
            vocabulary.setdefault(a + b, len(vocabulary))
        want = tiktoken.Encoding("r", pat_str=r"\S+", mergeable_ranks=vocabulary, special_tokens={})
        encoder = bpe.Encoder(vocabulary)
        for _ in range(300):
            data = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 40)))
            assert encoder.piece(data) == want._encode_single_piece(data), (seed, data)


def test_tokens_that_no_merge_makes():
    vocabulary = {bytes([i]): i for i in range(256)} | {b"abc": 256}
    want, encoder = tiktoken.Encoding("r", pat_str=r"\S+", mergeable_ranks=vocabulary, special_tokens={}), bpe.Encoder(vocabulary)
    for data in (b"abc", b"abcabc", b"xabc", b"ab"):
        assert encoder.piece(data) == want._encode_single_piece(data)
    with pytest.raises(ValueError, match="bytes without a token"):
        bpe.Encoder({b"a": 0})


def test_memory_bounds_do_not_change_ids(monkeypatch, library):
    for name, value in (("STATES", 40), ("PIECES", 50), ("BLOCK", 7), ("STEPS", 30), ("OFTEN", 0)):
        monkeypatch.setattr(bpe, name, value)
    texts, decoder = bpe.Texts(RANKS, public_tokenizers.PATTERN), bpe.Decoder({i: t for t, i in bpe.ranks(RANKS).items()})
    for text in [*ODD[:-1], "the cat sat on the mat. " * 30, *(f"w{i} v{i * i}" for i in range(60))]:
        ids = texts(text).tolist()
        assert ids == library.encode_ordinary(text)
        assert "".join([*(decoder.feed([i]) for i in ids), decoder.end()]) == text


def test_streaming_decode_of_malformed_bytes():
    decoder, draw = bpe.Decoder({i: bytes([i]) for i in range(256)}), random.Random(2)
    for _ in range(4000):
        data = bytes(draw.choice([0x41, 0x7F, 0x80, 0xBF, 0xC0, 0xC3, 0xA9, 0xE0, 0xE2, 0x82, 0xAC, 0xED, 0xA0, 0xF0, 0x9F, 0x99, 0xF4, 0x90, 0xF5]) for _ in range(draw.randint(0, 9)))
        assert "".join([*(decoder.feed([b]) for b in data), decoder.end()]) == data.decode("utf-8", "replace")


def test_byte_bpe(spark, library, documents, hard, empty):  # noqa: F811
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None, ODD[3]])], "doc_id long, text string")
    for docs in (documents, hard, odd):
        there = bpe.digest(bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS))
        got = there.collect()
        assert len(got) == docs.count()
        for r in got:
            want = library.encode_ordinary(r["text"] or "")
            assert (r["ids"] or []) == want and r["n_tokens"] == len(want) and r["decoded"] == r["text"]
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, ids string, decoded string")
    assert bpe.decode(bpe.encode(clash, RANKS, public_tokenizers.PATTERN), RANKS).select("decoded").first()[0] == "a b"
    nulls = spark.createDataFrame([(None,), ([],), ([64, None, 65],)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(nulls, RANKS).collect()] == [None, "", "ab"]


def test_byte_bpe_query(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    got = queries.op11_byte_bpe(spark, SF).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), align._byte_characters()


def aligned_directly(text, both):
    """(A ids and ends, B ids and ends) of a whole text by both libraries' bytes."""
    a, b, byte = both
    if not text:
        return [], [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    return ids_a, np.cumsum([len(x) for x in bytes_a]).tolist(), ids_b, np.cumsum([len(x) for x in bytes_b]).tolist()


def links_directly(text, both):
    """(groups, links) by trying every pair of tokens of a group."""
    a, a_ends, b, b_ends = aligned_directly(text, both)
    groups, links, low = [], [], 0
    i = j = 0
    for cut in sorted(set(a_ends) & set(b_ends)):
        ni, nj = i, j
        while ni < len(a) and a_ends[ni] <= cut:
            ni += 1
        while nj < len(b) and b_ends[nj] <= cut:
            nj += 1
        groups.append(",".join(map(str, a[i:ni])) + "|" + ",".join(map(str, b[j:nj])))
        for x in range(i, ni):
            for y in range(j, nj):
                starts = (a_ends[x - 1] if x > i else low, b_ends[y - 1] if y > j else low)
                if max(starts) < min(a_ends[x], b_ends[y]):
                    links.append((a[x], b[y]))
        i, j, low = ni, nj, cut
    return groups, links


def test_aligned_stretches_equal_whole_texts(both):
    aligner, draw = align.Aligner(A, B), random.Random(2)
    letters = "ab é🙂\n\t .,'s　日1_-"
    random_texts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(4000)]
    for text in [*ODD[:-1], *random_texts]:
        assert list(aligner.spans(text)) == list(aligned_directly(text, both)), text
        groups, links = links_directly(text, both)
        digest, sizes, pairs = aligner.batch([text])[0]
        assert sizes.tolist() == [len(x) for x in aligned_directly(text, both)[::2]] + [len(groups)]
        assert Counter(pairs.tolist()) == Counter(a << 24 | b for a, b in links)
        assert digest == (hashlib.sha256(";".join(groups).encode()).digest() if groups else None)


def test_aligner_keeps_what_it_meets_often(both, monkeypatch):
    monkeypatch.setattr(align, "STRETCHES", 60)
    monkeypatch.setattr(align, "BLOCK", 20)
    learnt, learn = Counter(), align.Aligner._learn
    monkeypatch.setattr(align.Aligner, "_learn", lambda self, keys: learnt.update(keys) or learn(self, keys))
    aligner, often = align.Aligner(A, B), ["the", "été", "of", "and", "日"]
    texts = [" ".join([*often, *(f"x{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'kl'[j]}" for j in range(2)), *often, "▁" * (i % 7 == 0)]) for i in range(100)]
    for text, (digest, _, _) in zip(texts, aligner.batch(texts), strict=True):
        groups, _ = links_directly(text, both)
        assert digest == (hashlib.sha256(";".join(groups).encode()).digest() if groups else None)
    assert all(learnt[f" {w}"] == 1 for w in often) and len(learnt) > 200


def test_aligner_takes_blocks_of_new_stretches(both, monkeypatch):
    monkeypatch.setattr(align, "STRETCHES", 100)
    monkeypatch.setattr(align, "BLOCK", 50)
    aligner, letters = align.Aligner(A, B), "abcdefghij"
    words = iter(f"{letters[i // 100]}{letters[i // 10 % 10]}{letters[i % 10]}" for i in range(1000))
    texts = [" ".join(next(words) for _ in range(49)) for _ in range(8)]
    for text, (digest, sizes, _) in zip(texts, aligner.batch(texts[:2]) + aligner.batch(texts[2:]), strict=True):
        groups, _ = links_directly(text, both)
        assert digest == hashlib.sha256(";".join(groups).encode()).digest() and sizes[2] == len(groups)


@pytest.mark.parametrize("few", [False, True])
def test_link_counts(spark, both, documents, hard, empty, monkeypatch, few):  # noqa: F811
    for name, value in (("COMMON", 20), ("BLOCK_DOCS", 30), ("BLOCK", 500), ("STRETCHES", 2000), ("HELD", 3000)) if few else ():
        monkeypatch.setattr(align, name, value)
    docs = documents.select("doc_id", "text").unionByName(hard.select("doc_id", "text"))
    table = [tuple(r) for r in docs.collect()]
    found = {t: links_directly(t, both) for _, t in table}
    count = Counter(p for _, t in table for p in set(found[t][1]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = Counter()
    for i, t in table:
        groups, links = found[t]
        n_a, n_b = (len(x) for x in aligned_directly(t, both)[::2])
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        want[i, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha] += 1
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = align.link_counts(docs, A, B).collect()
    assert Counter(tuple(r[c] for c in names) for r in got) == want
    assert align.link_counts(empty, A, B).count() == 0


def test_alignments(spark, both, hard):  # noqa: F811
    docs = hard.withColumnRenamed("label", "cuts")
    for r in align.alignments(docs, A, B).collect():
        a, a_ends, b, b_ends = aligned_directly(r["text"], both)
        assert (r["a_ids"], r["a_ends"], r["b_ids"], r["b_ends"]) == (a, a_ends, b, b_ends) and r["cuts"] == sorted(set(a_ends) & set(b_ends))


def whitened_directly(x, k):
    n, total = len(x), x.sum(axis=0)
    covariance = np.cov((x - 100_000).T.astype(float), bias=True).reshape(x.shape[1], -1)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total)) for row in x]
    return deviation, (x - total / n) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(covariance)


def test_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.op13_polarised_whitening(spark, SF).toPandas()
    given = table.toPandas()
    x = np.array([np.floor(1024 * np.array(v, float)).astype(np.int64) + 100_000 for v in given.embedding])
    deviation, whitened, explained = whitened_directly(x, 8)
    assert len(got) == 8 * len(x) and (got.n == len(x)).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[given.vec_id].to_numpy()
    assert np.allclose(wide * np.sign((wide * whitened).sum(axis=0)), whitened, atol=1e-10)
    assert dict(zip(got.vec_id, got.deviation)) == dict(zip(given.vec_id, deviation))
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-10)


def test_whitening_of_hard_rows(spark):
    nan = float("nan")
    odd = [(1, None), (2, []), (3, [1.0, nan]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [1e300, 0.0]), (None, [0.5, 2.0]), (8, [0.25, -1.0]), (8, [0.25, -1.0]), (9, [3.0, 1.5])]
    table = spark.createDataFrame([(i, v, 1, "c") for i, v in odd], "vec_id long, embedding array<double>, n int, component string")
    got = whitening.whiten(table).toPandas()
    x = np.array([[512, 2048], [256, -1024], [256, -1024], [3072, 1536]]) + 100_000
    deviation, whitened, explained = whitened_directly(x, 2)
    assert len(got) == 8 and got.vec_id.isna().sum() == 2 and (got.n == 4).all()
    assert sorted(got[got.component == 1].deviation) == sorted(deviation) and np.allclose(sorted(np.abs(got.whitened)), sorted(np.abs(whitened).ravel()))
    assert got.identity_error.iloc[0] < 1e-12 and np.allclose(got.groupby("component").explained.first(), explained)
    one = table.where("vec_id = 9")
    for flat in (table.limit(0), one, one.unionByName(one), table.where("vec_id < 6")):
        assert whitening.whiten(flat).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<float>")
    assert set(whitening.whiten(line).toPandas().component) == {1}  # one direction only


def test_whitening_is_exact_beyond_a_long(spark):
    rows = [(0, [1e15, 1.0]), (1, [-1e15, 2.0]), (2, [1.0, -3.0])]
    fit = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [[int(np.floor(1024 * v)) + 100_000 for v in r] for _, r in rows]
    sums = [sum(c) for c in zip(*x)]
    want = sum((3 * r[0] - sums[0]) ** 2 for r in x) / 27
    assert fit.sums == sums and fit.covariance[0, 0] == want
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got[got.vec_id == 0].deviation.isna().all()
    assert set(got[got.vec_id == 2].deviation) == {sum((3 * v - s) ** 2 for v, s in zip(x[2], sums))}


def test_whitening_polarises():
    """Covariances from variances of sums alone."""
    draw = np.random.default_rng(3)
    x = draw.integers(-50, 50, (40, 5))
    n, sums = len(x), x.sum(axis=0).tolist()
    z = n * x - x.sum(axis=0)
    squares = {i: int((z[:, i] ** 2).sum()) for i in range(5)} | {at: int(((z[:, i] + z[:, j]) ** 2).sum()) for at, (i, j) in enumerate(whitening.Whitening.places(5), 5)}
    assert np.allclose(whitening.Whitening(n, sums, squares).covariance, np.cov(x.T, bias=True), rtol=1e-12)


def test_targets_of_small_sources(spark):
    """Sources of any size, next to the block's or not, take their target to the word."""
    sizes = [1, 12, 63, 64, 65, 100, 130, 1000]
    docs, i = [], 0
    for k in range(60):
        left = sizes[k % len(sizes)]
        while left:
            n = min(left, 40)
            docs.append((i, "w " * n, f"s{k:03d}"))
            left, i = left - n, i + 1
    docs += [(i + k, "w " * 500, "zz") for k in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mixed(table).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    source = {d: s for d, _, s in docs}
    by = got.assign(source=got.doc_id.map(source)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert len(by) == 61 and (by.taken - by.target).abs().max() <= 0.5
    assert (by[by["size"] < 2000].target == 3 * by[by["size"] < 2000]["size"]).all()
    # the schedule itself gives nearly all slots; each source's ranks have no gaps
    _, slots = mixing.mix(table)
    slots = slots.toPandas()
    assert (slots.slot == slots.slot.max()).sum() < 0.05 * len(slots) + 61
    assert all(sorted(own["rank"]) == list(range(len(own))) for _, own in slots.groupby("id"))


def test_many_sources(spark, monkeypatch):
    """The ways for more sources than are broadcast, and sums by ranges, give the same mix."""
    docs = spark.createDataFrame([(i, "w " * (i % 7), f"host{i % 97}" if i % 3 else "hot") for i in range(900)], "doc_id long, text string, source string")
    want = mixing.mixed(docs, block_words=8).toPandas()
    monkeypatch.setattr(mixing, "FEW_SOURCES", 5)
    monkeypatch.setattr(mixing, "RUN", 10)
    monkeypatch.setattr(mixing, "CELLS", 16)
    got = mixing.mixed(docs, block_words=8).toPandas()
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert got.sort_values("doc_id")[columns].reset_index(drop=True).equals(want.sort_values("doc_id")[columns].reset_index(drop=True))


def test_ann_recall_with_few_reranks(spark):
    """Clustered vectors, a fiftieth of the rows reranked: the codes must find the neighbours."""
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(200, 32))
    x = centres[draw.integers(0, 200, 20_000)] + 0.35 * draw.normal(size=(20_000, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    asked = table.where("vec_id % 400 = 0")
    x32 = x.astype(np.float32).astype(float)

    def recall(again: int) -> float:
        got, hits = defaultdict(set), 0
        for r in ann.search(table, asked, top=20, again=again).collect():
            got[r["query_id"]].add(r["vec_id"])
        for q, found in got.items():
            score = x32 @ x32[q]
            score[q] = -np.inf
            hits += len(found & set(np.argsort(-score)[:20].tolist()))
        assert len(got) == 50
        return hits / (20 * len(got))

    assert recall(400) >= 0.9
    assert recall(20) >= 0.3  # codes alone; chance would be a thousandth

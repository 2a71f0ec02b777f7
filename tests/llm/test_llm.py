"""Each operator against a brute-force version, on the given tables and on hard small ones."""

import hashlib
import os
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinespark.llm import ann, chat, licenses, line_dedup, mixing, near_dedup, packing, quality, queries, sharding, token_counts
from kinespark.llm.components import connected_components
from tests.compare import rows
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, n long, class string, size string, words string, label string"
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
HARD = [
    (1, None, "s"), (2, "", "s"), (3, " \n\t ", None), (4, "word", "s"), (5, "word", "t"), (5, "word", "t"), (6, LONG, "s"), (7, LONG + " end", "u"),
    (8, PROSE, None), (9, PROSE + " more", "s"), (None, PROSE, "s"), (None, None, None), (10, "Licensed under CC BY-NC 4.0.\nGNU  General-Public License", "t"),
    (11, "<|endoftext|> a<|endoftext|>", "t"), (12, "日本語 テキスト   \U0001f600 ½ Ⅷ \U00011de0x", "t"), (13, "A b\nA b\nA  b", "u"),
]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names."""
    return spark.createDataFrame([(i, t, None, s, len(t) if t else None, "x", 1, "c", "s", "w", "l") for i, t, s in HARD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(ids, sets, percent):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_packing(documents, hard, empty):
    for docs, capacity in ((documents, 512), (hard, 64)):
        got = packing.pack(docs, capacity=capacity, group_pieces=50).toPandas()
        size = Counter()
        for r in docs.select("doc_id", "text").collect():
            size[r[0]] += len(words(r[1]))
        assert {k: v for k, v in size.items()} == {(None if k != k else k): int(v) for k, v in got.groupby("doc_id", dropna=False).n_words.sum().items()}
        placed = got[got.bin_id.notna()]
        for _, b in placed.groupby("bin_id"):
            assert b.n_words.sum() <= capacity and not b.source.duplicated().any()
            spans = sorted(zip(b.bin_offset, b.n_words))
            assert all(o + n == p for (o, n), (p, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert packing.pack(empty).count() == 0


def naive_best_fit(pieces, capacity):
    """(bin, offset) of (size, source, cluster) pieces: of all open bins without the piece's source
    and cluster, that with the least room that suffices, the first opened among equals."""
    bins, placed = [], []
    for size, source, cluster in pieces:
        free = [(capacity - b["used"], i) for i, b in enumerate(bins) if capacity - b["used"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        if free:
            i = min(free)[1]
        else:
            i = len(bins)
            bins.append({"used": 0, "sources": set(), "clusters": set()})
        placed.append((i, bins[i]["used"]))
        bins[i]["used"] += size
        bins[i]["sources"].add(source)
        bins[i]["clusters"].add(cluster)
    return placed


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_is_the_naive_scan(seed):
    r = np.random.default_rng(seed)
    pieces = [(int(r.integers(1, 101)), f"s{int(r.integers(3 + 9 * seed))}", int(r.integers(4 + 20 * seed))) for _ in range(400)]
    pieces.sort(key=lambda p: -p[0])
    assert packing.best_fit(*map(list, zip(*pieces)), 100) == naive_best_fit(pieces, 100)


def test_best_fit_takes_tightest_compatible():
    assert packing.best_fit([6, 5, 4, 4], ["a", "b", "a", "c"], [1, 2, 3, 4], 10) == [(0, 0), (1, 0), (1, 5), (0, 6)]


def test_packing_is_the_naive_scan_of_each_group(spark, documents, hard):
    groups = near_dedup.near_duplicates(documents).select("doc_id", "component_id").dropDuplicates(["doc_id"])
    clustered = documents.join(groups, "doc_id")
    for docs, capacity, cluster in ((documents, 512, None), (hard, 64, None), (clustered, 300, "component_id")):
        pieces, _ = packing.dealt_pieces(docs, capacity, 60, cluster)
        lots = defaultdict(list)
        for r in pieces.where("size > 0").collect():
            lots[r["g"]].append(r)
        want = set()
        for g, own in lots.items():
            own.sort(key=lambda r: (-r["size"], r["lot"]))
            for r, (b, o) in zip(own, naive_best_fit([(r["size"], r["source"], r["cluster"]) for r in own], capacity)):
                want.add((r["k1"], r["copy"], r["piece"], f"{g:x}-{b:x}", o, r["size"]))
        got = packing.pack(docs, capacity, 60, cluster).where("bin_id is not null").collect()
        assert len(got) == len(want) and {(r["k1"], r["copy"], r["piece"], r["bin_id"], r["bin_offset"], r["n_words"]) for r in got} == want


def test_packed_texts(spark, documents, hard):
    for docs in (documents.where("doc_id < 40"), hard, hard.union(hard)):
        texts = packing.packed_texts(docs, packing.pack(docs, 256), 256).collect()
        assert Counter(w for t in texts for w in words(t["text"])) == Counter(w for r in docs.select("text").collect() for w in words(r[0]))
        assert all(t["n_words"] == len(words(t["text"])) <= 256 for t in texts)


def test_token_counts(documents, hard, empty):
    path = queries.tokenizer_path()
    tokenizer = token_counts._tokenizer(path)
    for docs in (documents, hard):
        want = Counter((r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False))) for r in docs.select("doc_id", "text").collect())
        got = token_counts.token_counts(docs, path).collect()
        assert Counter((r[0], r[1], r[2]) for r in got) == want and all(r[3] == (r[2] > 1024) for r in got)
    assert token_counts.token_counts(empty, path).count() == 0


def test_mixing(documents, hard, empty):
    got = mixing.mixed(documents).toPandas()
    again = mixing.mixed(documents.repartition(5)).toPandas()
    assert rows(got) == rows(again)
    assert (got.taken <= 3 * got["size"]).all()
    for docs in (documents, hard):
        mixed = mixing.mixed(docs).toPandas()
        assert len(mixed) == docs.count()
        texts = mixing.mixed_documents(docs)
        assert texts.columns == docs.columns
        assert sum(len(words(r["text"])) for r in texts.collect()) == mixed.taken.sum()
    small = mixing.mixed(hard, block_words=1).toPandas()
    assert (small.taken <= 3 * small["size"]).all()
    assert mixing.mixed(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_targets_stop_at_three_times(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate([("a", 9000), ("b", 100), ("c", 100)])], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mixed(docs, block_words=4).collect()}
    assert got[1]["target"] == 300 and got[2]["target"] == 300 and got[0]["target"] == 8600
    assert got[1]["taken"] == 300 and abs(got[0]["taken"] - 8600) < 20


def test_mixed_documents_keep_rows_that_differ_in_nulls(spark):
    docs = spark.createDataFrame([(5, None, "one two three"), (5, "one two three", None), (5, "one two three", "s"), (5, "one two three", "s")], "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mixed(docs, block_words=1).collect():
        taken[r["size"]] += r["taken"]
    out = mixing.mixed_documents(docs, block_words=1).collect()
    assert all(r["text"] for r in out) and {r["source"] for r in out} == {None, "s"} and sum(len(words(r["text"])) for r in out) == taken[3]


def test_sharding_is_uniform(spark):
    """Over many seeds each row, one of forty copies included, is equally often in every shard and
    slot, and neighbours are equal as often as chance has it."""
    table = spark.createDataFrame([(i, "same" if i < 40 else f"t{i}") for i in [*range(40), *range(40, 80)]], "doc_id long, text string").selectExpr("if(doc_id < 40, 0, doc_id) as doc_id", "text")
    shards, same, equal, places = 4, Counter(), 0, Counter()
    was, sharding.PARTITION_ROWS = sharding.PARTITION_ROWS, 10
    try:
        seeds = 60
        for seed in range(seeds):
            got = sorted(sharding.shard(table, shards, seed).select("shard", "slot", "doc_id").collect())
            same.update(r["shard"] for r in got if r["doc_id"] == 0)
            places.update((r["shard"], r["slot"]) for r in got if r["doc_id"] == 0)
            equal += sum(a["doc_id"] == b["doc_id"] == 0 for a, b in zip(got, got[1:]) if a["shard"] == b["shard"])
    finally:
        sharding.PARTITION_ROWS = was
    # 40 of 80 rows are copies: every place has one with probability 1/2
    n = seeds * 80 / 2
    assert all(abs(x - n / shards) < 5 * (n / shards / 4) ** 0.5 for x in same.values())
    chi = sum((places[s, t] - seeds / 2) ** 2 / (seeds / 4) for s in range(shards) for t in range(20))
    assert chi < 80 + 5 * (2 * 80) ** 0.5
    pairs, p = seeds * 76, 40 * 39 / (80 * 79)
    assert abs(equal - pairs * p) < 6 * (pairs * p * (1 - p)) ** 0.5


def test_sharding(documents, hard, empty):
    for docs in (documents, hard):
        got = sharding.shard(docs).toPandas()
        n = got.groupby("shard").size().reindex(range(40), fill_value=0)
        assert n.max() - n.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
        want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in docs.select("doc_id", "text").collect())
        assert Counter((None if a != a else int(a), b, c) for a, b, c in zip(got.doc_id, got["size"], got.text_crc32)) == want
    assert sharding.shard(empty).count() == 0


def test_hypergeometric_law(spark):
    from pyspark.sql import functions as F

    n = 20_000
    d = spark.range(n).select(sharding.hypergeometric(F.lit(7), F.lit(30), F.lit(12), sharding.unit(F.lit(3), F.col("id"))).alias("x")).groupBy("x").count().collect()
    from math import comb

    for r in d:
        p = comb(7, r["x"]) * comb(23, 12 - r["x"]) / comb(30, 12)
        assert abs(r["count"] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4
    matrix = sharding.communication_matrix(spark.createDataFrame([(0, 500), (1, 300), (17, 200)], "p long, n long"), 18, 7, 1000).collect()
    assert {r["p"]: sum(r["row"]) for r in matrix} == {0: 500, 1: 300, 17: 200}
    assert sorted(map(sum, zip(*(r["row"] for r in matrix)))) == [142, 143, 143, 143, 143, 143, 143]


def test_line_dedup(hard, empty, spark):
    docs = spark.createDataFrame([(i, f"shared  line\nown {i}\n\nshared line", f"s{i % 6}", "old") for i in range(12)] + [(99, "rare\nown", "s0", "old")], "doc_id long, text string, source string, n_lines string")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs, 5).collect()}
    assert got[0]["text"] == "shared  line\nown 0\n" and got[0]["n_removed"] == 1 and got[0]["n_lines"] == 4
    assert all(got[i]["text"] == f"own {i}\n" for i in range(1, 12)) and got[99]["text"] == "rare\nown"
    out = line_dedup.line_dedup(hard, 3)
    assert out.count() == len(HARD) and {r["text"] for r in out.where("doc_id = 1").collect()} == {None}
    assert line_dedup.line_dedup(empty).count() == 0


def test_quality(documents, hard, empty, spark):
    def brute(text):
        w = words(text)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    for docs in (documents, hard):
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        got = Counter((r["doc_id"], *(r[c] for c in names)) for r in quality.quality(docs).collect())
        assert got == Counter((r[0], *brute(r[1])) for r in docs.select("doc_id", "text").collect())
    body = [" ".join("ab"[i % 2] + chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + j) for j in range(12)) for i in range(30)]
    docs = spark.createDataFrame([(i, "menu home 2024 about us contact privacy terms help site map\n" + (body[i] if i % 2 else "tail"), "h") for i in range(30)], "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(docs, min_docs=10).collect()}
    assert kept[0] and all(kept[i] == (i % 2 == 1) for i in range(1, 30))
    # the registered SQL says the same where lines are removed and documents rejected
    import duckdb

    lines = [(i, f"Menu {i} of the site\nshared line of the host with words {i}\n" + (body[i % 30] if i % 3 else f"tail {i}"), f"h{i % 2}" if i % 7 else None) for i in range(90)]
    table = spark.createDataFrame([*lines, (None, None, "h0")], "doc_id long, text string, source string")
    duck = duckdb.connect()
    given = table.toPandas()  # noqa: F841, read by name
    duck.execute("create view documents as select cast(doc_id as bigint) as doc_id, text, source from given")
    got = quality.quality(table).drop("k1", "k2").toPandas()
    assert (got.removed > 0).sum() > 60 and (~got.kept & ~got.base_failed).sum() > 20
    assert rows(got) == rows(duck.sql(queries.oracle_sql()["op8_quality_rules"]).df())
    assert quality.quality(empty).count() == 0 and quality.drop_low_quality(hard).columns == hard.columns


def brute_licenses(text, templates, percent=80):
    """Every block against every template on full sets."""
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    places = [(i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
    lists = [(label, re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())) for label, t in templates]
    sets = [(label, {tuple(t[i : i + 5]) for i in range(len(t) - 4)}) for label, t in lists]
    m, labels, score = max(len(t) for _, t in lists), set(), 0.0
    for b in range(0, max(1, len(w)), m):
        block = w[b : b + 2 * m]
        own = {tuple(block[i : i + 5]) for i in range(len(block) - 4)}
        met = [(label, s & own, len(s & own) / len(s)) for label, s in sets if 100 * len(s & own) >= percent * len(s)]
        for label, shared, part in met:
            if not any(shared < other for _, other, _ in met):
                labels.add(label)
                score = max(score, part)
    at, base = [i for i, _ in places], {x for _, x in places}
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score


#: Statements and what they must give.
LICENSED = {
    "All of it is licensed under the GNU GPL version 2.0 here": "gpl", "It was released under the BSD license.": "bsd", "Licensed under the MPL license, version 2.0": "",
    "As said in contract 4, section 0, by the parties, licensed under cc rules": "", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc", "Released under the MIT License.": "mit",
    "Licensed, under CC-BY-SA 4.0": "cc-by,cc-by-sa", "mit freundlichen under the license released": "", "version 2 0 license apache the under licensed": "",
    "released under the mit licence": "", "This work is licensed under the GNU Lesser General Public License": "lgpl", "no license at all, free software, all rights reserved": "",
}


def test_license_scan(documents, hard, empty, spark):
    r = np.random.default_rng(3)
    texts = [*LICENSED]
    for _, t in licenses.TEMPLATES:
        w = t.split()
        texts.append(f"{PROSE} {t} {PROSE}")
        texts.append(" ".join([f"x{i}" for i in range(int(r.integers(600)))] + [x for x in w if r.random() > 0.02] + w[:9]))
        texts.append(t + " " + licenses.TEMPLATES[int(r.integers(len(licenses.TEMPLATES)))][1])
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (documents, hard.drop("source"), own):
        got = Counter(map(tuple, licenses.license_scan(docs).drop("doc_id").collect()))
        assert got == Counter(brute_licenses(t, licenses.TEMPLATES) for (t,) in docs.select("text").collect())
    found = {r["doc_id"]: r["labels"] for r in licenses.license_scan(own).collect()}
    assert {t: found[i] for i, t in enumerate(LICENSED)} == LICENSED
    assert licenses.license_scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.license_scan(own, templates=[("x", "too short")])


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    path = queries.tokenizer_path()
    tokenizer = token_counts._tokenizer(path)
    n_tokens = lambda text: len(tokenizer.encode(text, add_special_tokens=False))
    turns = [
        (1, 0, "system", "be brief"), *[(1, i, "user" if i % 2 else "assistant", f"{said} \\ <\\| {i} " + "x " * 40) for i in range(1, 30)], (2, 0, None, None), (2, None, "assistant", "ü"),
        (None, 0, "assistant", "y"), (3, 0, "assistant", LONG), (3, 1, "user", "a\nb"), (3, 1, "user", "a\nb"), (4, 0, "odd\nrole\\n", said),
        (5, 0, "system", "long " * 100), *[(5, i, "assistant", "日本語のテキスト" * 4) for i in range(1, 9)], (6, 0, "system", "be brief"), (6, 1, "user", "x " * 150), (6, 2, "system", "be brief"), (6, 3, "assistant", "z"),
        (7, 0, "user", "a"), (7, 6, "system", "not first"), (7, 7, "user", "x " * 150), (7, 8, "assistant", "<|endoftext|>"),
    ]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, window string")
    groups = defaultdict(list)
    for c, t, r, x in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        groups[c].append((r or "", x or ""))
    for segment in (4096, 5):
        windows = chat.format_windows(table, path, budget=160, history=60, segment=segment)
        got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
        for c, own in groups.items():
            digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
            loss = "".join(x for r, x in own if r == "assistant")
            assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        every = windows.collect()
        for w in every:
            assert w["n_tokens"] == n_tokens(w["text"])
            system = n_tokens(chat.written(*groups[w["conv_id"]][0])) if groups[w["conv_id"]][0][0] == "system" else 0
            assert w["n_tokens"] <= 160 or w["n_new"] == 1 and w["n_repeated"] <= 1
            assert not system or w["text"].startswith(chat.written(*groups[w["conv_id"]][0]))
        sixth = [w for w in sorted(every, key=lambda w: w["window"]) if w["conv_id"] == 6]
        assert segment != 4096 or [w["n_new"] for w in sixth] == [1, 1, 2] and sixth[2]["n_repeated"] == 1  # an equal turn later on is a turn of its own
    first = chat.format_windows(table, path, budget=400, history=200).where("conv_id = 1").orderBy("window").collect()
    assert len(first) > 3 and any(w["n_repeated"] > 1 for w in first)
    assert chat.format_windows(table.limit(0), path).count() == 0
    for x in ("<|", "<\\|", "<\\\\|im_start|>", said, "<<||", ""):
        assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)


def naive_windows(turns, count, budget, history):
    """(first new turn, number of new, repeated turns' numbers) of each window, by trying spans."""
    system = [0] if turns and turns[0][0] == "system" else []
    out, at, past = [], 0, []
    while at < len(turns):
        head = system if at else []
        end = at + 1
        while end < len(turns) and sum(count[i] for i in [*head, *past, *range(at, end + 1)]) <= budget:
            end += 1
        out.append((at, end - at, [*head, *past]))
        if end == len(turns):
            break
        shown = [i for i in [*past, *range(at, end)] if i not in system]
        past = next(shown[i:] for i in range(len(shown) + 1) if sum(count[j] for j in shown[i:]) <= min(history, max(0, budget - count[end] - sum(count[j] for j in system))))
        at = end
    return out


def test_chat_windows_are_the_naive_ones(spark):
    path = queries.tokenizer_path()
    tokenizer = token_counts._tokenizer(path)
    for c, seed in enumerate(range(6)):
        r = np.random.default_rng(seed)
        turns = [("system" if not i and seed % 2 else "user" if i % 2 else "assistant", "wörd " * int(r.integers(1, 60))) for i in range(40)]
        count = [len(tokenizer.encode(chat.written(*t))) for t in turns]
        table = spark.createDataFrame([(c, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
        got = [(w["first_turn"], w["n_new"], w["n_repeated"], w["text"]) for w in chat.format_windows(table, path, 256, 100).orderBy("window").collect()]
        want = [(at, n, len(past), "".join(chat.written(*turns[i]) for i in [*past, *range(at, at + n)])) for at, n, past in naive_windows(turns, count, 256, 100)]
        assert got == want


def test_ann(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = ann.search(vectors, vectors.where("vec_id % 20 = 0")).toPandas()
    p = vectors.orderBy("vec_id").toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    hits = 0
    for q, g in got.groupby("query_id"):
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(g.vec_id))
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and np.allclose(g.score, x[g.vec_id] @ x[ids == q][0], atol=1e-12)
        assert all((a, -i) >= (b, -j) for (a, i), (b, j) in zip(zip(g.score, g.vec_id), list(zip(g.score, g.vec_id))[1:]))
    assert hits >= 0.9 * len(got)
    odd = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5])]
    table = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    found = ann.search(table, table.where("vec_id % 20 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(found, key=tuple)] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    assert ann.search(table.limit(0), table).count() == 0 and ann.search(table, table.limit(0)).count() == 0


def test_ann_repeated_rows_doubles_and_clashing_names(spark):
    r = np.random.default_rng(1)
    x = [*r.normal(size=(60, 5)), *([[1e300, 0, 0, 0, 0]] * 2), *([[0.1, 0.2, 0.3, 0.4, 0.5]] * 30)]
    ids = [*range(60), 70, 80, *range(100, 130)]
    given = [(i, [float(v) for v in y]) for i, y in zip(ids, x)]
    given += [given[0], given[0], given[7], (20, given[3][1])]  # rows that come again, and an id with another vector
    schema = "vec_id long, embedding array<double>, q long, c string, ids int, x double, block int"
    table = spark.createDataFrame([(i, y, 1, "c", 2, 0.5, 3) for i, y in given], schema)
    asked = [(i, y) for i, y in given if i % 20 == 0]
    got = defaultdict(list)
    for row in ann.search(table, table.where("vec_id % 20 = 0"), top=20, again=400).collect():
        got[row["query_id"]].append((row["rank"], row["vec_id"], row["score"]))
    assert sum(map(len, got.values())) == 20 * len(asked)
    for q in {i for i, _ in asked}:
        want = []
        for y in (y for i, y in asked if i == q):
            near = sorted((-float(np.dot(np.array(v), np.array(y))), i) for i, v in given if i != q)[:20]
            want += [(k + 1, i, -s) for k, (s, i) in enumerate(near)]
        mine, want = sorted(got[q], key=lambda t: (t[0], t[1])), sorted(want, key=lambda t: (t[0], t[1]))
        assert np.allclose([t[2] for t in mine], [t[2] for t in want], rtol=1e-12) and [t[:2] for t in mine] == [t[:2] for t in want]


def test_near_duplicates(documents, hard, empty):
    for docs, width, percent in ((documents, 3, 85), (documents, 5, 80), (hard, 3, 85)):
        own = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        sets = [shingles(t, width) for _, t in own]
        want = components([i for i, _ in own], sets, percent)
        got = near_dedup.near_duplicates(docs, width, percent).collect()
        expect = Counter((i, len(s), w if s else i, (w == i if w is not None else True) if s else True) for (i, _), s, w in zip(own, sets, want))
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == expect
    left = near_dedup.drop_near_duplicates(documents)
    own = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = components([i for i, _ in own], [shingles(t, 5) for _, t in own], 80)
    assert {r["doc_id"] for r in left.collect()} == {i for (i, t), w in zip(own, want) if w == i or not words(t)} and left.columns == documents.columns
    assert near_dedup.near_duplicates(empty).count() == 0 and near_dedup.drop_near_duplicates(empty).count() == 0


def test_near_threshold_group(spark):
    """A group whose members are near the threshold of one another, dealt over several blocks."""
    r = np.random.default_rng(5)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(150):
        w = list(base)
        for j in r.choice(60, i % 4, replace=False):
            w[j] = f"n{i}x{j}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components(list(range(150)), [shingles(t, 3) for t in texts], 85)
    was = near_dedup.BLOCK_CLASSES
    try:
        near_dedup.BLOCK_CLASSES = 20
        got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(docs).collect()}
    finally:
        near_dedup.BLOCK_CLASSES = was
    assert [got[i] for i in range(150)] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    labels = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(labels[i] == 0 for i in range(41)) and labels[100] == labels[101] == 100


def test_pipeline(spark, documents):
    """Every stage of run() on what the one before kept, against SQL or brute force."""
    import duckdb

    import corpus_pipeline

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def sql(name, path):
        duck = duckdb.connect()
        duck.execute(f"create view documents as select * from '{path}/*.parquet'")
        return {r["doc_id"]: r for r in duck.sql(queries.oracle_sql()[name]).df().to_dict("records")}

    path = f"{folder}/documents"
    documents.write.parquet(path)
    docs = before = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns, name
        was, path = path, f"{folder}/{name}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        given, got = {r["doc_id"]: r for r in before.collect()}, docs.collect()
        if name == "quality_rules":
            kept = {i for i, r in sql("op8_quality_rules", was).items() if r["kept"]}
            assert Counter(got) == Counter(given[i] for i in kept) and 0 < len(given) - len(kept) < 60
        elif name == "line_dedup":
            want = sql("op5_line_dedup", was)
            assert {r["doc_id"]: r["text"] for r in got} == {i: want[i]["text"] if want[i]["n_removed"] else given[i]["text"] for i in given} and len(got) == len(given)
        elif name == "near_duplicates":
            own = sorted(given)
            group = components(own, [shingles(given[i]["text"], 5) for i in own], 80)
            assert Counter(got) == Counter(given[i] for i, g in zip(own, group) if i == g or not words(given[i]["text"])) and len(got) < len(own)
        else:
            taken = {i: r["taken"] for i, r in sql("op3_source_mixing", was).items() if r["taken"]}
            found = defaultdict(list)
            for r in got:
                found[r["doc_id"]].append(r["text"])
            for i, texts in found.items():
                whole = given[i]["text"]
                part = [t for t in texts if t != whole]
                assert len(part) <= 1 and sum(len(words(t)) for t in texts) == taken[i] and all(words(t) == words(whole)[: len(words(t))] for t in part)
            assert set(found) == set(taken)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    pieces, _ = packing.dealt_pieces(docs, 2048)
    lots = defaultdict(list)
    for r in pieces.where("size > 0").collect():
        lots[r["g"]].append(r)
    want = set()
    for g, own in lots.items():
        own.sort(key=lambda r: (-r["size"], r["lot"]))
        for r, (b, o) in zip(own, naive_best_fit([(r["size"], r["source"], r["cluster"]) for r in own], 2048)):
            want.add((r["k1"], r["copy"], r["piece"], f"{g:x}-{b:x}", o, r["size"]))
    assert {(r["k1"], r["copy"], r["piece"], r["bin_id"], r["bin_offset"], r["n_words"]) for r in got.where("bin_id is not null").collect()} == want
    texts = packing.packed_texts(docs, got)
    assert Counter(w for r in texts.collect() for w in words(r["text"])) == Counter(w for r in docs.collect() for w in words(r["text"]))
    assert rows(corpus_pipeline.run(spark, SF).toPandas()) == rows(got.toPandas())


def test_scratch_is_cleared(spark, tmp_path):
    from kinespark.llm import common

    table = common.stored(spark.range(3).toDF("x"))
    assert table.count() == 3 and os.path.isdir(common.scratch(spark))
    common.clear(spark)
    assert not os.path.exists(common.scratch(spark))


@pytest.mark.parametrize("stage", ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "best_fit_packing"])
def test_stages_on_hard_tables(spark, hard, empty, stage):
    """Nulls, empty and long texts, repeated rows and clashing names in; defined rows out."""
    import corpus_pipeline

    run = dict(corpus_pipeline.STAGES)[stage]
    out, none = run(spark, hard, SF), run(spark, empty, SF)
    assert none.count() == 0 and none.columns == out.columns
    if stage != "best_fit_packing":
        assert out.columns == hard.columns and none.schema == empty.schema
    got = [(r["doc_id"], r["text"], r["source"]) for r in out.collect()] if stage != "best_fit_packing" else out.toPandas()
    given = [(i, t, s) for i, t, s in HARD]
    if stage == "quality_rules":
        kept = [r["kept"] for r in quality.quality(hard).collect()]
        assert len(got) == sum(kept) and set(got) <= set(given) and (None, PROSE, "s") in got and (1, None, "s") not in got
    elif stage == "line_dedup":
        assert Counter(map(str, got)) == Counter(map(str, given))  # no line stands on five sites
    elif stage == "near_duplicates":
        assert Counter(i for i, _, _ in got) == Counter([1, 2, 3, 4, 6, 8, None, 10, 11, 12, 13])  # of 4, 5, 5; of 6, 7; of 8, 9, null
    elif stage == "mix_sources":
        taken = {}
        for r in mixing.mixed(hard, weights=(1, 2, 3), most=3).collect():
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
        found = Counter()
        for i, t, _ in got:
            found[i] += len(words(t))
        assert dict(found) == {i: n for i, n in taken.items() if n}
    else:
        assert got.n_words.sum() == sum(len(words(t)) for _, t, _ in given)
        assert got.groupby("bin_id").n_words.sum().max() <= 2048
        assert got.bin_id.isna().sum() == sum(not words(t) for _, t, _ in given)

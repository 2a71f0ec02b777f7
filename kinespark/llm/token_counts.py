"""Token counts without token ids: a tokenizer splits a text into pre-tokens and encodes each
by itself, so a document's count is the sum of its pre-tokens' piece counts.

One pass over the texts turns a block of documents into its pre-token frequencies: one row for
each distinct pre-token of the block with packed pairs (document, frequency). The rows are
shuffled by pre-token; the distinct pre-tokens of that same exchange are encoded, each once,
joined back to the frequencies and summed by document.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Byte-level pre-token pattern, fixed by the tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text bytes and documents of one block of frequencies.
BLOCK_BYTES, BLOCK_DOCS = 48_000_000, 60_000
#: A pre-token that more documents of a block hold is dealt over SALTS tasks.
COMMON, SALTS = 2_000, 256
#: Pairs that a task holds before it passes their sums on.
HELD = 8_000_000
#: Packed rows: frequencies of a pre-token (greater ones in several pairs), what a block knows
#: of each document at once, and sums by document.
PAIRS, MOST = [("doc", "<u2"), ("n", "u1")], 255
BASE = [("sum", "<i8"), ("bytes", "<i8"), ("id", "<i8"), ("null", "<i8")]
SUMS = [("doc", "<u2"), ("n", "<i8")]


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@functools.cache
def _specials(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


@functools.cache
def _encoded(path: str) -> Callable[[list[str]], list[int]]:
    tokenizer = _tokenizer(path)
    tokenizer.encode_special_tokens = True
    return lambda pieces: [len(e) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def _ranges(ok: Callable[[str], bool], stop: int) -> str:
    """The characters below `stop` that are ok, as the inside of a character class."""
    spans, start = [], None
    for c in range(stop + 1):
        here = c < stop and not 0xD800 <= c < 0xE000 and ok(chr(c))
        if here and start is None:
            start = c
        elif not here and start is not None:
            spans.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(spans)


@functools.cache
def _splitter(path: str) -> Callable[[str], list[str]]:
    """Pre-tokens of a text. The pattern is PRE_TOKEN with its classes spelled out below
    U+10000, which the standard library matches fastest; texts with characters above it take
    PRE_TOKEN itself. Libraries disagree on characters newer than their Unicode tables, so a
    text with a character unknown to Python's table is split by the tokenizer."""
    kind = unicodedata.category
    letter, digit, space = (_ranges(ok, 0x10000) for ok in (lambda c: kind(c)[0] == "L", lambda c: kind(c)[0] == "N", lambda c: c.isspace() and c not in "\x1c\x1d\x1e\x1f"))
    fast = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    odd = re.compile(f"[{_ranges(lambda c: kind(c) == 'Cn', 0x10000)}\U00010000-\U0010ffff]").search
    high = regex.compile(PRE_TOKEN).findall
    split = _tokenizer(path).pre_tokenizer.pre_tokenize_str

    def pieces(text: str) -> list[str]:
        if text.isascii() or not odd(text):
            return fast(text)
        if any(kind(c) == "Cn" for c in set(text)):
            return [text[a:b] for _, (a, b) in split(text)]
        return high(text)

    return pieces


def _frequencies(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _splitter(path)
        specials = _specials(path)
        special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        task, made = TaskContext.get().partitionId(), 0
        number: defaultdict[str, int] = defaultdict()

        def fresh() -> tuple[list, list, list, list]:
            number.clear()
            number.default_factory = number.__len__
            return [], [], [], []

        ids, n_bytes, at_once, found = fresh()

        def block() -> pa.RecordBatch:
            nonlocal made
            key = (task << 24) + made
            made += 1
            texts = list(number)
            length = np.array([len(x) for x in found], np.int64)
            doc = np.repeat(np.arange(len(found), dtype=np.int64), length)
            pair, n = np.unique(np.concatenate([*found, np.empty(0, np.int64)]) * max(1, len(found)) + doc, return_counts=True)
            times = -(-n // MOST)  # 1 for all but the greatest frequencies
            last = np.cumsum(times) - 1
            pair = np.repeat(pair, times)
            packed = np.full(len(pair), MOST, PAIRS)
            packed["doc"] = pair % max(1, len(found))
            packed["n"][last] = n - (times - 1) * MOST
            token = pair // max(1, len(found))
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
            ends = np.r_[starts[1:], len(token)][: len(starts)]
            offsets = pa.array(np.r_[starts, len(token)] * packed.itemsize, pa.int32()).buffers()[1]
            pairs = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(packed.tobytes())])
            base = np.empty(len(found), BASE)
            base["sum"], base["bytes"], base["id"], base["null"] = at_once, n_bytes, [i or 0 for i in ids], [i is None for i in ids]
            salt = np.where(ends - starts > COMMON, 1 + key % SALTS, 0)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(["", *(texts[i] for i in token[starts])], pa.string()),
                    pa.array(np.r_[1 + key % SALTS, salt], pa.int32()),
                    pa.array(np.full(1 + len(starts), key), pa.int64()),
                    pa.concat_arrays([pa.array([base.tobytes()], pa.binary()), pairs]),
                ],
                ["piece", "salt", "block", "docs"],
            )

        total = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                parts = special.split(text) if any(s in text for s in specials) else [text]
                ids.append(doc_id)
                n_bytes.append(len(text.encode()))
                at_once.append(len(parts) - 1)
                pieces = find(text) if len(parts) == 1 else [x for p in parts for x in find(p)]
                found.append(np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces)))
                total += n_bytes[-1]
                if total >= BLOCK_BYTES or len(found) >= BLOCK_DOCS:
                    yield block()
                    total = 0
                    ids, n_bytes, at_once, found = fresh()
        if found:
            yield block()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoded(path)
        for batch in batches:
            n = pa.array(count(batch.column("piece").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("salted"), n], ["piece", "salted", "n"])

    return run


def counter(path: str) -> Callable[[str], int]:
    """Tokens of one text after another, for use inside a task; pre-tokens seen before are
    remembered, up to a bound."""
    find, encode, specials = _splitter(path), _encoded(path), _specials(path)
    special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
    known: dict[str, int] = {}

    def count(text: str) -> int:
        parts = special.split(text) if any(s in text for s in specials) else [text]
        pieces = [x for p in parts for x in find(p)]
        if len(known) > 500_000:
            known.clear()
        fresh = list(set(pieces).difference(known))
        if fresh:
            known.update(zip(fresh, encode(fresh), strict=True))
        return len(parts) - 1 + sum(map(known.__getitem__, pieces))

    return count


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, base, sums) from joined frequencies: the packed sums of a block's documents, and
    its base row as it came. Memory is bounded by HELD."""
    held: dict[int, tuple[list[np.ndarray], list[int]]] = {}
    n_held = 0

    def out() -> pa.RecordBatch:
        packed = []
        for parts, pieces in held.values():
            pair = np.concatenate(parts)
            doc, at = np.unique(pair["doc"], return_inverse=True)
            one = np.empty(len(doc), SUMS)
            one["doc"], one["n"] = doc, np.bincount(at, weights=pair["n"] * np.repeat(pieces, [len(x) for x in parts]))
            packed.append(one.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([False] * len(held)), pa.array(packed, pa.binary())], ["block", "base", "sums"])

    for batch in batches:
        piece, block, n = (batch.column(c).to_pylist() for c in ("piece", "block", "n"))
        for i, docs in enumerate(batch.column("docs")):
            if piece[i] == "":
                yield pa.RecordBatch.from_arrays([pa.array([block[i]], pa.int64()), pa.array([True]), pa.array([docs.as_py()], pa.binary())], ["block", "base", "sums"])
                continue
            parts, pieces = held.setdefault(block[i], ([], []))
            parts.append(np.frombuffer(docs.as_py(), PAIRS))
            pieces.append(n[i])
            n_held += len(parts[-1])
        if n_held >= HELD:
            yield out()
            held, n_held = {}, 0
    if held:
        yield out()


def _documents(key, table):
    kinds, payloads = table.column("base").to_pylist(), table.column("sums").to_pylist()
    base = np.frombuffer(payloads[kinds.index(True)], BASE)
    total = base["sum"].copy()
    for kind, payload in zip(kinds, payloads, strict=True):
        if not kind:
            part = np.frombuffer(payload, SUMS)
            total[part["doc"]] += part["n"]
    return pa.table({"doc_id": pa.array(base["id"], pa.int64(), mask=base["null"] > 0), "n_bytes": base["bytes"], "n_tokens": total})


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of `docs`.

    n_tokens is what the byte-level tokenizer in the file `path` gives for the whole text with
    its special strings recognised and nothing added, cut or padded; n_bytes is the text's
    UTF-8 length; over_limit is n_tokens > limit. `path` must name the file on every executor.

    Null and empty texts count 0. Repeated rows and null ids keep their own rows. Blocks hold
    at most BLOCK_DOCS documents; `docs` should be a table scan (or a checkpoint), whose rows
    come in the same order if a task is run again. Other columns are ignored.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = T.StructType(
        [T.StructField("piece", T.StringType(), False), T.StructField("salt", T.IntegerType(), False), T.StructField("block", T.LongType(), False), T.StructField("docs", T.BinaryType(), False)]
    )
    spread = docs.select("doc_id", "text").mapInArrow(_frequencies(path), whole).repartition(n, "piece", "salt")
    # `mass` makes this branch use every column, so both branches read one exchange of the texts' pass
    distinct = spread.groupBy("piece").agg(F.max(F.col("salt") > 0).alias("salted"), F.sum(F.octet_length("docs") + F.col("block") % 2).alias("mass"))
    counts = T.StructType([whole["piece"], T.StructField("salted", T.BooleanType(), False), T.StructField("n", T.LongType(), False)])
    counted = distinct.select("piece", "salted", "mass").mapInArrow(_pieces(path), counts)
    # only counts of common pre-tokens meet their frequencies in several tasks
    salts = F.when(F.col("salted"), F.sequence(F.lit(0), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    counted = counted.select("piece", F.explode(salts).alias("salt"), "n")
    sums = spread.join(counted.hint("merge"), ["piece", "salt"]).select("piece", "block", "docs", "n").mapInArrow(_summed, "block long, base boolean, sums binary")
    rows = sums.groupBy("block").applyInArrow(_documents, "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)

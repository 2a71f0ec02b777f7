"""Two tokenizers' tokens of the same text, aligned by bytes, and how often they meet.

A is a byte-level tokenizer (tokenizers library) of " " + text, B a piece model with byte fallback
(sentencepiece) of the text, to which it adds that space. A token ends where the bytes of the
tokens up to it do, once these bytes are found to be the text's; the libraries' spans name
characters, and several tokens may share one.

Both tokenizers work on short stretches of a text by themselves: A's pre-tokens, joined where a
piece of B has the two characters at the cut side by side and so may join over it. Each distinct
stretch is encoded and aligned once, many together, and texts are put together from stretches;
those met often are kept. In a run of bytes both tokenizers' ends together cut it into segments; each lies in one token of A
and one of B, and these are the links.

How many documents hold a pair of ids linked is counted like words: a pass over the texts turns a
block of documents into one row for each distinct pair, with packed (document, number); these rows
are shuffled by pair, counted, joined with the counts and summed by document.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .token_counts import _splitter

#: Stretches that a worker keeps, the longest it keeps, and how many are looked up or learnt at once.
STRETCHES, LONG, BLOCK = 300_000, 200, 20_000
#: Rows that are aligned at once.
ROWS = 256
#: Text bytes and documents of one block.
BLOCK_BYTES, BLOCK_DOCS = 48_000_000, 60_000
#: A pair that more documents of a block hold is dealt over SALTS tasks.
COMMON, SALTS = 2_000, 256
#: Entries that a task holds before it passes their sums on.
HELD = 4_000_000
#: A packed row: its block, then documents (two bytes each) and numbers (four bytes each).
HEAD, EACH = 8, 6
BASE = [("id", "<i8"), ("null", "u1"), ("n_a", "<i8"), ("n_b", "<i8"), ("n_groups", "<i8"), ("n_links", "<i8"), ("sha", "V32")]
SUMS = [("doc", "<u2"), ("n_best", "<i8"), ("count_sum", "<i8")]


def _byte_characters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 stands for
    itself, the other bytes follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _none() -> tuple[None, np.ndarray, np.ndarray]:
    return None, np.zeros(3, np.int64), np.empty(0, np.uint64)


class Aligner:
    """Both tokenizers, and what was aligned before. The piece model must leave texts as they are."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        of = _byte_characters()
        self.a_bytes = {i: bytes(of[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        model = proto.ModelProto()
        with open(b_path, "rb") as file:
            model.ParseFromString(file.read())
        normal = model.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a piece model that changes texts, or adds no space before them, can't be aligned by bytes")
        normal.add_dummy_prefix = False  # stretches bring their own space
        self.b = SentencePieceProcessor(model_proto=model.SerializeToString())
        byte, whole = proto.ModelProto.SentencePiece.BYTE, [p.piece.replace("▁", " ") for p in model.pieces]
        self.b_bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == byte else w.encode() for p, w in zip(model.pieces, whole, strict=True)]
        pairs = {w[i : i + 2] for w in whole for i in range(len(w) - 1)}
        self.side_by_side = np.sort(np.array([ord(p[0]) << 21 | ord(p[1]) for p in pairs], np.int64))
        self.split = _splitter(a_path)
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        # each id as text, with what follows it: within its side, and at its side's end in a group
        sides = [(len(self.a_size), ",|"), (len(self.b_size), ",;")]
        self.names = np.array([f"{i}{end}" for n, ends in sides for end in ends for i in range(n)], object)
        self._clear()

    def _clear(self) -> None:
        self._number([])
        self.texts: list[str | None] = []
        room = STRETCHES + 2 * BLOCK + 1  # a block is looked up once it is passed, by a text of its size at most
        self.ends_in = np.zeros((2, room), np.int64)  # first and last character
        self.sizes = np.zeros((room, 3), np.int64)
        self.uses = np.zeros(room, np.int64)
        self.start = np.zeros(room + 1, np.int64)
        self.codes = np.empty(1 << 18, np.uint64)

    def _number(self, keys: list[str | tuple[str, ...]]) -> None:
        self.number: defaultdict[str | tuple[str, ...], int] = defaultdict(None, zip(keys, range(len(keys)), strict=True))
        self.number.default_factory = self.number.__len__

    def _make_room(self) -> None:
        """Where too many stretches are known, keep two thirds at most: the most used, if used more
        than once."""
        n = len(self.number)
        if n <= STRETCHES:
            return
        at = np.argsort(-self.uses[:n], kind="stable")[: 2 * STRETCHES // 3]
        at = np.sort(at[self.uses[at] > 1])
        keys, texts, k = list(self.number), self.texts, len(at)
        self.codes, many = self._codes(at)
        self.start[1 : k + 1] = np.cumsum(many)
        self.ends_in[:, :k], self.sizes[:k], self.uses[:k] = self.ends_in[:, at], self.sizes[at], self.uses[at] // 2
        self.uses[k:] = 0
        self.texts = [texts[i] for i in at.tolist()]
        self._number([keys[i] for i in at.tolist()])

    def tokens(self, keys: list[str | tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Which stretches, each a pre-token or a tuple of joined ones, both tokenizers keep to the
        byte; and of these, one behind another: the bytes where each ends, ids of A and of B, and
        the bytes where these end."""
        data = ["".join(k).encode() for k in keys]
        of_a = self.a.encode([x for k in keys for x in ((k,) if isinstance(k, str) else k)], is_pretokenized=True, add_special_tokens=False).ids
        of_b = self.b.encode(data, out_type=int, num_threads=1)
        ids, there = (of_a, list(chain.from_iterable(of_b))), np.ones(len(keys), bool)
        arrays, last, ends = self._ends(data, ids)
        whole = b"".join(data)
        if not all(b"".join(map(of.__getitem__, i)) == whole and np.isin(last, e).all() for of, i, e in zip((self.a_bytes, self.b_bytes), ids, ends, strict=True)):
            pieces = [(k,) if isinstance(k, str) else k for k in keys]
            each = iter(self.a.encode_batch([x for p in pieces for x in p], add_special_tokens=False))
            own = [[i for e in islice(each, len(p)) for i in e.ids] for p in pieces]
            same = [all(b"".join(of[i] for i in x) == d for of, x in ((self.a_bytes, a), (self.b_bytes, b))) for a, b, d in zip(own, of_b, data, strict=True)]
            there = np.array(same, bool)
            ids = tuple([i for x, ok in zip(of, same, strict=True) if ok for i in x] for of in (own, of_b))
            arrays, last, ends = self._ends([d for d, ok in zip(data, same, strict=True) if ok], ids)
        return there, last, arrays, ends

    def _ends(self, data: list[bytes], ids: tuple[list[int], list[int]]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        arrays = [np.array(i, np.int64) for i in ids]
        last = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        return arrays, last, [np.cumsum(of[i]) for of, i in zip((self.a_size, self.b_size), arrays, strict=True)]

    def _learn(self, keys: list[str | tuple[str, ...]]) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """(groups as text or None, numbers of A tokens, B tokens and groups, numbers of links,
        pairs of all links) of stretches."""
        there, last, ids, ends = self.tokens(keys)
        sizes, many = np.zeros((len(keys), 3), np.int64), np.zeros(len(keys), np.int64)
        if not len(last):
            return [None] * len(keys), sizes, many, np.empty(0, np.uint64)
        both = np.sort(np.concatenate(ends), kind="stable")
        twice = both[1:] == both[:-1]
        cuts, common = both[np.r_[True, ~twice]], both[1:][twice]
        a, b = (of[np.searchsorted(e, cuts)] for of, e in zip(ids, ends, strict=True))
        codes = (a.astype(np.uint64) << np.uint64(24)) | b.astype(np.uint64)
        n_a, n_b, links, groups = (np.diff(np.searchsorted(x, last, "right"), prepend=0) for x in (*ends, cuts, common))
        # all tokens by group, those of A first; the last of its side in a group has another end
        group = [np.searchsorted(common, e) for e in ends]
        order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
        closes = [common[g] == e for g, e in zip(group, ends, strict=True)]
        n, m = len(self.a_size), len(self.b_size)
        texts = self.names[np.concatenate([ids[0] + n * closes[0], 2 * n + ids[1] + m * closes[1]])[order]].tolist()
        at = np.cumsum(n_a + n_b).tolist()
        made = iter(["".join(texts[i:j])[:-1] for i, j in zip([0, *at], at, strict=False)])
        sizes[there], many[there] = np.stack([n_a, n_b, groups], axis=1), links
        return [next(made) if x else None for x in there.tolist()], sizes, many, codes

    def _add(self, n: int) -> None:
        """Learn the stretches that were numbered from n on."""
        keys = list(islice(reversed(self.number), len(self.number) - n))[::-1]
        for lo in range(0, len(keys), BLOCK):
            some = keys[lo : lo + BLOCK]
            texts, sizes, many, codes = self._learn(some)
            to = n + len(some)
            end = self.start[n] + len(codes)
            if end > len(self.codes):
                self.codes = np.concatenate([self.codes, np.empty(max(end - len(self.codes), len(self.codes)), np.uint64)])
            self.codes[self.start[n] : end] = codes
            self.start[n + 1 : to + 1] = self.start[n] + np.cumsum(many)
            self.sizes[n:to] = sizes
            self.texts += texts
            self.ends_in[:, n:to] = [[ord(k[0][0]) for k in some], [ord(k[-1][-1]) for k in some]]
            n = to

    def _numbers(self, keys: list[str | tuple[str, ...]]) -> np.ndarray:
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        if len(self.number) > known:
            self._add(known)
        np.add.at(self.uses, at, 1)
        return at

    def _joined(self, pieces: list[str]) -> list[str | tuple[str, ...]]:
        """Pre-tokens as stretches: those that B may join over are put into one tuple."""
        first, last = ([ord(p[i]) for p in pieces] for i in (0, -1))
        pair = np.array(last[:-1], np.int64) << 21 | np.array(first[1:], np.int64)
        over = self._over(pair)
        if not over.any():
            return pieces
        starts = [0, *(np.flatnonzero(~over) + 1).tolist(), len(pieces)]
        return [pieces[i] if j - i == 1 else tuple(pieces[i:j]) for i, j in zip(starts, starts[1:], strict=False)]

    def _over(self, pair: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.side_by_side, pair), len(self.side_by_side) - 1)
        return self.side_by_side[at] == pair

    def batch(self, texts: list[str | None]) -> list[tuple[bytes | None, np.ndarray, np.ndarray]]:
        """(digest of the groups, numbers of A tokens, B tokens and groups, pairs of all links)
        of whole texts; None, zeros and no pairs without tokens. Texts are put together here from
        pre-tokens; the few that have joined or very long ones go by themselves."""
        out: list[tuple | None] = [_none() for _ in texts]
        held: list[tuple[int, list[str]]] = []
        n = 0

        def flush() -> None:
            nonlocal n
            self._make_room()
            at = self._numbers([p for _, own in held for p in own])
            over = np.zeros(len(at), bool)
            over[:-1] = self._over(self.ends_in[1, at[:-1]] << 21 | self.ends_in[0, at[1:]])
            lo, alone = 0, []
            for i, own in held:
                hi = lo + len(own)
                if over[lo : hi - 1].any():
                    alone.append((i, own))
                else:
                    texts_of, sizes, codes = self._parts(at[lo:hi])
                    if None not in texts_of:
                        out[i] = (hashlib.sha256(";".join(texts_of).encode()).digest(), sizes, codes)
                lo = hi
            for i, own in alone:
                out[i] = self._alone(own)
            held.clear()
            n = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            pieces = self.split(" " + text)
            if len(pieces) > BLOCK or max(map(len, pieces)) > LONG:
                out[i] = self._alone(pieces)
                continue
            held.append((i, pieces))
            n += len(pieces)
            if n > BLOCK:
                flush()
        if held:
            flush()
        return out

    def _alone(self, pieces: list[str]) -> tuple[bytes | None, np.ndarray, np.ndarray]:
        digest, sizes, pairs, first = hashlib.sha256(), np.zeros(3, np.int64), [], True
        keys = self._joined(pieces)
        lo = 0
        while lo < len(keys):
            long = sum(map(len, keys[lo])) > LONG if isinstance(keys[lo], tuple) else len(keys[lo]) > LONG
            hi = lo + 1
            if long:  # aligned anew each time
                texts, size, _, codes = self._learn([keys[lo]])
                size = size[0]
            else:
                while hi < len(keys) and hi - lo < BLOCK and sum(map(len, keys[hi])) <= LONG:
                    hi += 1
                self._make_room()
                texts, size, codes = self._parts(self._numbers(keys[lo:hi]))
            if None in texts:
                return _none()
            digest.update((b"" if first else b";") + ";".join(texts).encode())
            sizes, first, lo = sizes + size, False, hi
            pairs.append(codes)
        return digest.digest(), sizes, np.concatenate(pairs)

    def _parts(self, at: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        return [self.texts[i] for i in at.tolist()], self.sizes[at].sum(axis=0), self._codes(at)[0]

    def _codes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.start[at + 1] - self.start[at]
        ends = np.cumsum(n)
        return self.codes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - ends + n, n)], n

    def spans(self, text: str | None) -> tuple[list[int], list[int], list[int], list[int]]:
        """(ids and byte ends of A, ids and byte ends of B) of a whole text, empty without tokens."""
        if not text:
            return [], [], [], []
        there, _, ids, ends = self.tokens(self._joined(self.split(" " + text)))
        if not there.all():
            return [], [], [], []
        return ids[0].tolist(), ends[0].tolist(), ids[1].tolist(), ends[1].tolist()


@functools.cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs with a_ids, a_ends, b_ids, b_ends and cuts (arrays of int): the tokens of " " + text by
    A and of text by B with the byte where each ends, and the bytes where both end one.

    Texts that are null or empty, or whose tokens' bytes aren't those of " " + text (B writes
    U+2581 as a space), have empty arrays. Columns of these names are replaced; others stay.
    """
    names = ["a_ids", "a_ends", "b_ids", "b_ends", "cuts"]
    rest = [c for c in docs.columns if c not in names]
    kept = docs.select(*rest)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                found = [aligner.spans(t) for t in part.column("text").to_pylist()]
                found = [(*x, sorted(set(x[1]).intersection(x[3]))) for x in found]
                made = [pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*rest, *names])

    return kept.mapInArrow(run, schema)


def _blocks(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        task, made = TaskContext.get().partitionId(), 0
        base: list[tuple] = []
        links: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal made
            key = (task << 24) + made
            made += 1
            # in place: a block has millions of links
            length = [len(x) for x in links]
            both = np.concatenate(links)
            links.clear()
            both <<= np.uint64(16)
            both |= np.repeat(np.arange(len(length), dtype=np.uint16), length)
            both.sort()
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.empty(0, np.int64)
            n = np.diff(first, append=len(both)).astype("<u4")
            both = both[first]
            doc = both.astype("<u2")  # the last 16 bits
            both >>= np.uint64(16)
            pair = both
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, np.int64)
            ends = np.r_[starts[1:], len(pair)][: len(starts)]
            head = key.to_bytes(8, "little")
            packed = [head + np.array(base, BASE).tobytes()]
            packed += [head + doc[i:j].tobytes() + n[i:j].tobytes() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            codes = pair[starts]
            salt = np.where(ends - starts > COMMON, 1 + key % SALTS, 0)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[-1, (codes >> np.uint64(24)).astype(np.int32)], pa.int32()),
                    pa.array(np.r_[-1, (codes & np.uint64(0xFFFFFF)).astype(np.int32)], pa.int32()),
                    pa.array(np.r_[1 + key % SALTS, salt], pa.int32()),
                    pa.array(packed, pa.binary()),
                ],
                ["a", "b", "salt", "docs"],
            )

        total = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                texts = part.column("text").to_pylist()
                for doc_id, text, (sha, sizes, pairs) in zip(part.column("doc_id").to_pylist(), texts, aligner.batch(texts), strict=True):
                    base.append((doc_id or 0, doc_id is None, *sizes.tolist(), len(pairs), sha or b"\0" * 32))
                    links.append(pairs)
                    total += len(text or "")
                    if total >= BLOCK_BYTES or len(base) >= BLOCK_DOCS:
                        yield block()
                        total, base, links = 0, [], []
        if base:
            yield block()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, base, sums) from joined rows: a block's base as it came, and its documents' sums."""
    held: defaultdict[int, list[tuple]] = defaultdict(list)
    n_held = 0

    def out() -> pa.RecordBatch:
        packed = []
        for parts_of in held.values():
            doc, n = (np.concatenate([x[i] for x in parts_of]) for i in (0, 1))
            each = [len(x[0]) for x in parts_of]
            count, best = (np.repeat([x[i] for x in parts_of], each) for i in (2, 3))
            docs, at = np.unique(doc, return_inverse=True)
            one = np.zeros(len(docs), SUMS)
            one["doc"] = docs
            np.add.at(one["n_best"], at, n * best)
            np.add.at(one["count_sum"], at, n * count)
            packed.append(one.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([False] * len(held)), pa.array(packed, pa.binary())], ["block", "base", "sums"])

    for batch in batches:
        a, count, best = (batch.column(c).to_pylist() for c in ("a", "n", "best"))
        for i, docs in enumerate(batch.column("docs").to_pylist()):
            block = int.from_bytes(docs[:HEAD], "little")
            if a[i] < 0:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([True]), pa.array([docs[HEAD:]], pa.binary())], ["block", "base", "sums"])
                continue
            k = (len(docs) - HEAD) // EACH
            held[block].append((np.frombuffer(docs, "<u2", k, HEAD), np.frombuffer(docs, "<u4", k, HEAD + 2 * k).astype(np.int64), count[i], best[i]))
            n_held += k + 16
        if n_held >= HELD:
            yield out()
            held.clear()
            n_held = 0
    if held:
        yield out()


def _documents(key, table):
    kinds, payloads = table.column("base").to_pylist(), table.column("sums").to_pylist()
    base = np.frombuffer(payloads[kinds.index(True)], BASE)
    best, counts = np.zeros((2, len(base)), np.int64)
    for kind, payload in zip(kinds, payloads, strict=True):
        if not kind:
            part = np.frombuffer(payload, SUMS)
            best[part["doc"]] += part["n_best"]
            counts[part["doc"]] += part["count_sum"]
    sha = ["" if n == 0 else s.tobytes().hex() for n, s in zip(base["n_a"].tolist(), base["sha"], strict=True)]
    numbers = {c: base[c] for c in ("n_a", "n_b", "n_groups", "n_links")}
    return pa.table({"doc_id": pa.array(base["id"], pa.int64(), mask=base["null"] > 0), **numbers, "n_best": best, "count_sum": counts, "groups_sha256": sha})


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each
    row of `docs`.

    Groups lie between bytes where both tokenizers end a token; links are all pairs of a token of
    A and one of B whose bytes overlap. A pair of ids counts the rows of `docs` that hold it
    linked; n_best is the number of links whose count is the highest of all pairs with their A id,
    count_sum the sum of the counts over the links. groups_sha256 is the lowercase hex digest of
    `a1,a2|b1;a3|b2,b3`.

    Rows without tokens (see alignments()) have zeros and ''. Repeated rows and null ids keep
    their own rows and count each. Blocks hold at most BLOCK_DOCS documents; `docs` should be a
    table scan (or a checkpoint), whose rows come in the same order if a task is run again. Other
    columns are ignored. Both paths must name the files on every executor.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = T.StructType([*[T.StructField(c, T.IntegerType(), False) for c in ("a", "b", "salt")], T.StructField("docs", T.BinaryType(), False)])
    # both branches use every column, so they read one exchange of the texts' pass
    spread = docs.select("doc_id", "text").mapInArrow(_blocks(a_path, b_path), whole).repartition(n, "a", "b", "salt")
    in_row = F.floor((F.octet_length("docs") - HEAD) / EACH)
    counted = spread.groupBy("a", "b").agg(F.sum(in_row).alias("n"), F.max(F.col("salt") > 0).alias("salted"))
    # an A id has at most as many rows here as B has pieces
    counted = counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))
    salts = F.when(F.col("salted"), F.sequence(F.lit(0), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    counted = counted.select("a", "b", F.explode(salts).alias("salt"), "n", "best")
    joined = spread.join(counted.hint("merge"), ["a", "b", "salt"]).select("a", "docs", "n", "best")
    sums = joined.mapInArrow(_summed, "block long, base boolean, sums binary")
    return sums.groupBy("block").applyInArrow(_documents, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

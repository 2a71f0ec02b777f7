"""Byte-level BPE as a transducer, and the way back.

Encoding. A sequence of tokens is what the merges make of its bytes exactly if each two
neighbours are: if merging their bytes alone gives the two again. So the merges compile into a
nondeterministic transducer that reads bytes along the vocabulary's trie and may end a token
wherever it agrees with the one before. Its states are made deterministic while texts are read:
a state holds every reading that is still open, a step drops those that die and emits the tokens
on which all that are left agree. A reading lives no longer than its open token, so what waits
is bounded by the longest token. A step becomes deterministic once it has been met OFTEN times;
until then the rest of a text is read from the nondeterministic transducer, one reading after
another. So rare words make no states, which are kept up to a bound.

Decoding. Tokens pass a UTF-8 automaton whose state is the start of an unfinished character; its
steps by token are kept too. A byte that can't go on gives U+FFFD for the longest start of a
character, as decoders do.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States, steps of the decoder, and distinct pre-tokens with their ids that a worker keeps.
STATES, STEPS, PIECES = 60_000, 200_000, 600_000
#: Meetings after which a step is made deterministic; until then they are counted from _MET on.
OFTEN, _MET = 4, 1 << 40
#: Rows that are encoded or decoded at once, and pre-tokens that are looked up at once.
ROWS, BLOCK = 256, 100_000
#: Pre-tokens longer than this are encoded anew each time.
LONG = 200
#: The end of a text's part before a space; a space after white space starts no part.
_AFTER_SPACE = re.compile(r"\s ")
_PARTS = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")


def ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def parts(text: str) -> list[str]:
    """The text cut before every space that follows other than white space, where any byte-level
    pattern starts a pre-token; all but the first part lose that space."""
    if not _AFTER_SPACE.search(text):
        return text.split(" ")
    head = len(text) - len(text.lstrip())
    first = text.find(" ", head)
    if first < 0:
        return [text]
    while first >= 0 and text[first - 1].isspace():
        first = text.find(" ", first + 1)
    if first < 0:
        return [text]
    return [text[:first], *(x[1:] for x in _PARTS.findall(text, first))]


def _spelled(pattern: str) -> str:
    """The pattern with its classes of letters, numbers and white space spelled out below U+10000,
    which the standard library reads, and reads fastest."""
    kind = unicodedata.category
    sets = {
        r"\p{L}": lambda c: kind(c)[0] == "L",
        r"\p{N}": lambda c: kind(c)[0] == "N",
        r"\s": lambda c: c.isspace() and c not in "\x1c\x1d\x1e\x1f",
    }
    found = {}
    for name, ok in sets.items():
        good = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and ok(chr(c))]
        starts = [c for c, before in zip(good, [-2, *good], strict=False) if c != before + 1]
        ends = [c for c, after in zip(good, [*good[1:], -2], strict=True) if after != c + 1]
        found[name] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))
    found[r"\S"] = "^" + found[r"\s"]
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        inside = (inside or part == "[") and part != "]"
        out.append(part if part not in found else found[part] if inside else f"[{found[part]}]")
    return "".join(out)


class Splitter:
    """Pre-tokens of a text by a pattern over letters, numbers and white space. A character that
    Python's table doesn't know is classed by the library itself and stands in as one it knows."""

    KINDS = {"a": "ɐ", "1": "٠", "!": "§"}  # letter, number, other: not ASCII, which patterns name

    def __init__(self, pattern: str):
        self.pattern = pattern
        self.fast = re.compile(_spelled(pattern)).findall
        self.find = regex.compile(pattern).findall
        self.odd = re.compile(f"[{''.join(re.escape(chr(c)) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == 'Cn')}\U00010000-\U0010ffff]").search
        self.known: dict[str, str] = {}

    def _stand_in(self, char: str) -> str:
        import tiktoken

        for probe, other in self.KINDS.items():
            vocabulary = {bytes([i]): i for i in range(256)} | {(probe + char).encode(): 256}
            if len(tiktoken.Encoding("probe", pat_str=self.pattern, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary(probe + char)) == 1:
                return other
        return "\u2003"

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.odd(text):
            return self.fast(text)
        odd = {c for c in set(text) if unicodedata.category(c) == "Cn"}
        if not odd:
            return self.find(text)
        for c in odd - self.known.keys():
            self.known[c] = self._stand_in(c)
        out, at = [], 0
        for piece in self.find(text.translate({ord(c): self.known[c] for c in odd})):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out


class Encoder:
    """The lazily determinised transducer of a vocabulary with ranks. Every byte must be a token."""

    def __init__(self, vocabulary: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in vocabulary]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        self.vocabulary = vocabulary
        self.bytes_of = {i: t for t, i in vocabulary.items()}
        self.size = {i: len(t) for t, i in vocabulary.items()}
        self.alone = [vocabulary[bytes([b])] for b in range(256)]
        # the trie: node and byte to the next node, with two bits that say whether it goes on and ends a token
        # longest: the longest token on the way to a node
        child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        inner: set[int] = set()
        for token, rank in vocabulary.items():
            node = 0
            for b in token:
                inner.add(node)
                node = child.setdefault(node << 8 | b, len(child) + 1)
            self.token_at[node] = rank
        self.longest = [-1] * (len(child) + 1)
        for key, node in child.items():  # a node comes after those on the way to it
            self.longest[node] = self.token_at.get(node, self.longest[key >> 8])
        self.next_shorter: dict[int, int] = {}
        self.child = {key: node << 2 | (node in inner) << 1 | (node in self.token_at) for key, node in child.items()}
        # nodes that two bytes lead to, with the bits
        self.two = {bytes([key & 255, b]): self.child[node << 8 | b] for key, node in child.items() if key < 256 for b in range(256) if node << 8 | b in child}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.agrees: dict[int, bool] = {}
        self.waits = 0
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [(None, ((0, ()),))]
        self.number = {self.states[0]: 0}
        # state and byte to the next state, or to the complement of a place in `emits`
        self.go: dict[int, int] = {}
        self.emits: list[tuple[int, tuple[int, ...]]] = []

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, and for a token that the
        merges never make."""
        if token not in self.split:
            found = [bytes([b]) for b in self.bytes_of[token]]
            while len(found) > 2:
                pairs = [(self.vocabulary.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(found, found[1:]))]
                rank, i = min(pairs)
                if rank == np.inf:
                    break
                found[i : i + 2] = [found[i] + found[i + 1]]
            self.split[token] = (self.vocabulary[found[0]], self.vocabulary[found[1]]) if len(found) == 2 else None
        return self.split[token]

    def _made(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self._halves(token) is not None

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at this token's left (0) or right (1) end while it is made, from
        a byte on, each with the rank of the merge that ends it."""
        key = (token, side)
        if key not in self.spines:
            spine, end = [], np.inf
            while True:
                spine.append((token, end))
                halves = self._halves(token)
                if halves is None:
                    break
                token, end = halves[side], token
            self.spines[key] = spine[::-1]
        return self.spines[key]

    def agree(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both gives these two tokens: no merge over their border
        comes before the merges that make them. Of equal merges the left one comes first."""
        if not self._made(b):
            return False
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (x, ends_x), (y, ends_y) = left[i], right[j]
            over = self.vocabulary.get(self.bytes_of[x] + self.bytes_of[y])
            if over is not None and over < ends_x and over <= ends_y:
                return False
            if ends_x == ends_y == np.inf:
                return True
            if ends_x <= ends_y:
                i += 1
            else:
                j += 1

    def _agree(self, before: int | None, token: int) -> bool:
        if before is None:
            return self._made(token)
        key = before << 32 | token
        good = self.agrees.get(key)
        if good is None:
            if len(self.agrees) > 4 * STATES:
                self.agrees.clear()
            good = self.agrees[key] = self.agree(before, token)
        return good

    def _shorter(self, token: int) -> int:
        """The next shorter token that this one starts with, or -1."""
        if token not in self.next_shorter:
            data = self.bytes_of[token]
            self.next_shorter[token] = next((self.vocabulary[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.vocabulary), -1)
        return self.next_shorter[token]

    def _rest(self, last: int | None, data: bytes, at: int) -> list[int]:
        """The tokens of data[at:] after the token `last`: readings one by one, the longest token
        first. As bytes have one encoding, a place reached in vain isn't tried again."""
        child, agrees, longest, size, two, alone = self.child, self.agrees, self.longest, self.size, self.two, self.alone
        out: list[int] = []
        dead: set[int] = set()
        end, before = len(data), last
        while at < end:
            step = two.get(data[at : at + 2])
            if step is None:
                token = alone[data[at]]
            else:
                node = step >> 2
                if step & 2:
                    for i in range(at + 2, end):
                        step = child.get(node << 8 | data[i])
                        if step is None:
                            break
                        node = step >> 2
                        if not step & 2:
                            break
                token = longest[node]
            while True:
                while token >= 0:
                    if not dead or at + size[token] not in dead:
                        good = agrees.get(before << 32 | token) if before is not None else None
                        if good or (good is None and self._agree(before, token)):
                            break
                    token = self._shorter(token)
                if token >= 0:
                    break
                dead.add(at)
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else last
                token = self._shorter(token)
            out.append(token)
            before = token
            at += size[token]
        return out

    def _step(self, state: int, byte: int) -> int:
        """The step of a state at a byte, kept for the next time."""
        last, readings = self.states[state]
        child, after, ended = self.child, [], None
        for node, waiting in readings:
            step = child.get(node << 8 | byte, 0)
            if step & 2:
                after.append((step >> 2, waiting))
            if step & 1 and ended is None and self._agree(waiting[-1] if waiting else last, token := self.token_at[step >> 2]):
                ended = (*waiting, token)
        shared = len(ended)
        for _, waiting in after:
            n = min(shared, len(waiting))
            while n and waiting[:n] != ended[:n]:
                n -= 1
            shared = n
        emitted = ended[:shared]
        if shared:
            last, ended = emitted[-1], ended[shared:]
            after = [(n, w[shared:]) for n, w in after]
        found = (last, (*after, (0, ended)))
        number = self.number.get(found)
        if number is None:
            number = self.number[found] = len(self.states)
            self.states.append(found)
            self.waits = max(self.waits, len(ended))
        if shared:
            self.emits.append((number, emitted))
            number = ~(len(self.emits) - 1)
        self.go[state << 8 | byte] = number
        return number

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one pre-token. A vocabulary entry that merges can't make stands for
        itself alone, as in the library."""
        whole = self.vocabulary.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES or len(self.go) > 4 * STATES:
            self._clear()
        state, out, go, at = 0, [], self.go, 0
        for byte in data:
            key = state << 8 | byte
            step = go.get(key)
            if step is None:
                go[key] = _MET
                break
            if step >= _MET:
                if step < _MET + OFTEN:
                    go[key] = step + 1
                    break
                step = self._step(state, byte)
            if step < 0:
                state, emitted = self.emits[~step]
                out += emitted
            else:
                state = step
        else:
            return out + [*self.states[state][1][-1][1]]
        size = self.size
        for token in out:
            at += size[token]
        return out + self._rest(out[-1] if out else None, data, at)


class Decoder:
    """The UTF-8 automaton over tokens. feed() takes tokens as they come, end() what is left."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.steps: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}
        self.n = 0
        self.state = b""

    @staticmethod
    def _second(lead: int) -> tuple[int, int]:
        """Bounds of the byte after a lead byte."""
        return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))

    def _step(self, state: bytes, data: bytes) -> tuple[str, bytes]:
        out: list[str] = []
        for byte in data:
            if state:
                low, high = self._second(state[0]) if len(state) == 1 else (0x80, 0xBF)
                if low <= byte <= high:
                    state += bytes([byte])
                    if len(state) == (2 if state[0] < 0xE0 else 3 if state[0] < 0xF0 else 4):
                        out.append(state.decode())
                        state = b""
                    continue
                out.append("�")
                state = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                state = bytes([byte])
            else:
                out.append("�")
        return "".join(out), state

    def feed(self, tokens: list[int]) -> str:
        """The characters that these tokens finish. A token without an entry is an error."""
        steps, state, out = self.steps, self.state, []
        here = steps[state]
        for token in tokens:
            step = here.get(token)
            if step is None:
                if self.n > STEPS:
                    steps.clear()
                    self.n = 0
                    here = steps.setdefault(state, {})
                step = here[token] = self._step(state, self.bytes_of[token])
                self.n += 1
            out.append(step[0])
            if step[1] != state:
                state = step[1]
                here = steps.setdefault(state, {})
        self.state = state
        return "".join(out)

    def end(self) -> str:
        left, self.state = self.state, b""
        self.steps.setdefault(b"", {})
        return "�" if left else ""


class Texts:
    """Ids of whole texts, with those of the pre-tokens seen before kept up to PIECES."""

    def __init__(self, path: str, pattern: str):
        self.encoder = Encoder(ranks(path))
        self.split = Splitter(pattern)
        self._clear()

    def _clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids = np.empty(1 << 16, np.int32)
        self.start = np.zeros(PIECES + BLOCK + 1, np.int64)

    def _add(self, n: int) -> None:
        """Encode the pre-tokens that were numbered from n on."""
        found = [self.encoder.piece(p.encode()) for p in list(islice(reversed(self.number), len(self.number) - n))[::-1]]
        ends = self.start[n] + np.cumsum([len(x) for x in found])
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(ends[-1] - len(self.ids), len(self.ids)), np.int32)])
        self.ids[self.start[n] : ends[-1]] = [i for x in found for i in x]
        self.start[n + 1 : len(self.number) + 1] = ends

    def __call__(self, text: str) -> np.ndarray:
        pieces = self.split(text)
        found: list[np.ndarray] = [np.empty(0, np.int32)]
        run: list[str] = []
        for lo in range(0, len(pieces), BLOCK):
            some = pieces[lo : lo + BLOCK]
            if len(max(some, key=len)) <= LONG:
                found.append(self._gathered(some))
                continue
            for p in some:
                if len(p) > LONG:
                    found += [self._gathered(run), np.array(self.encoder.piece(p.encode()), np.int32)]
                    run = []
                else:
                    run.append(p)
            found.append(self._gathered(run))
            run = []
        return np.concatenate(found) if len(found) > 2 else found[-1]

    def _gathered(self, pieces: list[str]) -> np.ndarray:
        if len(self.number) > PIECES:
            self._clear()
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        if len(self.number) > known:
            self._add(known)
        n = self.start[at + 1] - self.start[at]
        ends = np.cumsum(n)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - ends + n, n)
        return self.ids[where]


@functools.cache
def _texts(path: str, pattern: str) -> Texts:
    return Texts(path, pattern)


@functools.cache
def _decoder(path: str) -> Decoder:
    return Decoder({i: t for t, i in ranks(path).items()})


def _with(df: DataFrame, column: str, kind: T.DataType, over: str, made) -> DataFrame:
    """df with `column` (replaced if it is there) made from batches of the column `over`."""
    rest = [c for c in df.columns if c != column]
    schema = T.StructType([*df.select(*rest).schema.fields, T.StructField(column, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], made(part.column(over))], [*rest, column])

    return df.select(*rest).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """docs with a column `ids` (array of int): the tokens of the whole `text` by the ranks in
    the file `path`, each match of `pattern` by itself, without special tokens.

    Null gives null, an empty text no tokens. Rows are neither moved nor joined, so repeats, ties
    and other columns stay as they are; a column named like `ids` is replaced. Row order within a
    partition is kept. `path` must name the file on every executor.
    """

    def made(texts: pa.Array) -> pa.Array:
        encoded = _texts(path, pattern)
        found = [None if t is None else encoded(t) for t in texts.to_pylist()]
        offsets = np.cumsum([0, *(0 if x is None else len(x) for x in found)])
        flat = np.concatenate([x for x in found if x is not None] or [np.empty(0, np.int32)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in found]))

    return _with(docs, ids, T.ArrayType(T.IntegerType(), True), "text", made)


def decode(encoded: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """encoded with a column `decoded`: the text of its tokens. Null gives null, no tokens the
    empty text, null tokens are skipped; malformed bytes give U+FFFD; a token that the file
    doesn't hold is an error."""

    def made(rows: pa.Array) -> pa.Array:
        decoder = _decoder(path)
        found = []
        for row in rows:
            if not row.is_valid:
                found.append(None)
                continue
            values = row.values
            if values.null_count:
                values = values.drop_null()
            whole = values.to_numpy(zero_copy_only=False)
            runs = [decoder.feed(whole[i : i + 65_536].tolist()) for i in range(0, len(whole), 65_536)]
            found.append("".join([*runs, decoder.end()]))
        return pa.array(found, pa.string())

    return _with(encoded, column, T.StringType(), ids, made)


def digest(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """encoded with n_tokens (long) and ids_sha256: the lowercase hex digest of the decimal ids
    joined by single spaces; a null list counts as an empty one."""
    some = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    return encoded.withColumns({"n_tokens": F.size(some).cast("long"), "ids_sha256": F.sha2(F.array_join(some.cast("array<string>"), " "), 256)})

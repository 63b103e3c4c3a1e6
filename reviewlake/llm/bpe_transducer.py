"""Byte-level BPE by a finite-state transducer that is determinised lazily, and decoding by an incremental UTF-8 state machine.

Ids are the encoding of a piece exactly if each two neighbours, merged from their bytes alone, stay these two. So the encoding of
every prefix of a piece ends in one token, and a nondeterministic transducer may guess token after token: a guess is a place in the
trie of tokens and the ids before it. A state of the deterministic one is the set of guesses still open, less the ids that all of them
share: those are emitted. Guesses end with the longest token, which bounds the lookahead. States and their transitions are made as text
needs them: a piece runs through known states, makes one more where it leaves them, and its rest is only simulated; so what pieces have
in common is determinised bit by bit, until the table is full.

Texts are cut by the vocabulary's pattern; pieces met before in a worker come from a bounded table.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States, pairs and pieces that a worker keeps, and characters that are cut into pieces at once.
STATES, PAIRS, PIECES, AT_ONCE = 150_000, 400_000, 400_000, 1_000_000
#: So near its end a piece emits nothing before it ends.
FAR_END = 64
#: Ids that a stream decodes at once.
CHUNK = 1 << 16
NOTHING, FAR = -1, 1 << 40
#: White space, letters and numbers among the first 256 characters: with these written out, the standard library's expressions cut twice as fast.
SPACE, LETTER, DIGIT = r"\t-\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
WIDE = re.compile("[^\x00-\xff]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """States are (place of the longest guess, id emitted last, ids that end at each byte since): other guesses are suffixes of the longest one."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # place * 256 + byte: place; the root is 0
        token, depth, parent, byte = [NOTHING], [0], [0], [0]  # by place
        for t, i in ranks.items():
            at = 0
            for b in t:
                to = self.child.setdefault(at << 8 | b, len(token))
                if to == len(token):
                    token.append(NOTHING)
                    depth.append(depth[at] + 1)
                    parent.append(at)
                    byte.append(b)
                at = to
            token[at] = i
        self.depth = depth
        self.shorter = [0] * len(token)  # by place, the place of its longest proper suffix
        self.endings: list[tuple] = [()] * len(token)  # by place, the tokens that it ends in and their lengths, the longest first
        for at in sorted(range(1, len(token)), key=depth.__getitem__):
            if depth[at] > 1:
                self.shorter[at] = self.place(self.shorter[parent[at]], byte[at])
            own = ((depth[at], token[at]),) if token[at] != NOTHING else ()
            self.endings[at] = own + self.endings[self.shorter[at]]
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple] = {}
        self.states = [(0, NOTHING, ())]
        self.number = {self.states[0]: 0}
        self.go: dict[int, int | tuple] = {}  # state * 256 + byte: the next state, with the ids emitted if there are any

    def place(self, at: int, byte: int) -> int:
        """The place of the longest suffix of a place's bytes and one more."""
        while (to := self.child.get(at << 8 | byte)) is None and at:
            at = self.shorter[at]
        return to or 0

    def stay(self, before: int, token: int) -> bool:
        """Whether two neighbours stay as they are when merged from bytes; before may be NOTHING."""
        key = (before + 1) << 32 | token
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stay(before, token)
        return known

    def history(self, token: int) -> tuple[list[int], bool, list[bytes], list[bytes]]:
        """Ranks of the merges that make a token of bytes, in their order, with FAR behind; whether one token is left; its first and last part before each."""
        if (known := self.made.get(token)) is None:
            parts = [bytes((b,)) for b in self.tokens[token]]
            cost = [self.ranks.get(a + b, FAR) for a, b in zip(parts, parts[1:], strict=False)]
            order, firsts, lasts = [], [parts[0]], [parts[-1]]
            while cost and (least := min(cost)) < FAR:
                k = cost.index(least)  # of equal ones the leftmost
                parts[k] += parts.pop(k + 1)
                del cost[k]
                if k:
                    cost[k - 1] = self.ranks.get(parts[k - 1] + parts[k], FAR)
                if k < len(cost):
                    cost[k] = self.ranks.get(parts[k] + parts[k + 1], FAR)
                order.append(least)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            known = self.made[token] = ([*order, FAR], len(parts) == 1, firsts, lasts)
        return known

    def _stay(self, before: int, token: int) -> bool:
        """Run the merges within both by rank, the left one's first if equal, and see whether the pair across the border ever comes first."""
        right, whole, firsts, _ = self.history(token)
        if before == NOTHING or not whole:
            return whole
        left, whole, _, lasts = self.history(before)
        i = j = 0
        while whole:
            a, b = left[i], right[j]
            across = self.ranks.get(lasts[i] + firsts[j], FAR)
            if across < a and across <= b and across < FAR:
                return False
            if a == b == FAR:
                return True
            if a <= b:
                i += 1
            else:
                j += 1
        return False

    def path(self, ids: list[int] | tuple[int, ...]) -> list[int]:
        """Of ids that end at each byte, those that the encoding of all bytes is made of, the last first."""
        out, at = [], len(ids)
        while at:
            out.append(ids[at - 1])
            at -= self.size[out[-1]]
        return out

    def ending(self, at: int, last: int, ids: list[int] | tuple[int, ...]) -> int:
        """The id that ends the encoding of the bytes read, which end in a place; ids: those that end at each byte before."""
        pairs, n = self.pairs, len(ids) + 1
        for size, t in self.endings[at]:
            before = ids[n - size - 1] if size < n else last
            known = pairs.get((before + 1) << 32 | t)
            if known or known is None and self.stay(before, t):
                return t
        raise ValueError("a byte isn't in the vocabulary")

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The state after a byte, and the ids that can be emitted now."""
        at, last, ids = state
        at = self.place(at, byte)
        ids += (self.ending(at, last, ids),)
        emitted: tuple[int, ...] = ()
        if (oldest := len(ids) - self.depth[at]) > 0:  # no guess begins before it: emit what the encodings of all prefixes from there on share
            open_, size = set(range(oldest, len(ids) + 1)), self.size
            while len(open_) > 1:  # the last of them goes back by its token, until all have met
                k = max(open_)
                open_.remove(k)
                open_.add(k - size[ids[k - 1]])
            if common := open_.pop():
                emitted = tuple(self.path(ids[:common])[::-1])
                last, ids = emitted[-1], ids[common:]
        return (at, last, ids), emitted

    def keep(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one more transition."""
        key, emitted = self.step(self.states[number], byte)
        to = self.number.setdefault(key, len(self.states))
        if to == len(self.states):
            self.states.append(key)
        self.go[number << 8 | byte] = (to, emitted) if emitted else to
        return to, emitted

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """A piece runs through known states; where it leaves them one more is made, while there is room, and the rest is only simulated."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        number, out, go = 0, [], self.go
        for k, b in enumerate(piece):
            made = go.get(number << 8 | b)
            if made is None:
                break
            if made.__class__ is int:
                number = made
            else:
                number, emitted = made
                out += emitted
        else:
            return (*out, *self.path(self.states[number][2])[::-1])
        if len(self.states) < STATES:
            number, emitted = self.keep(number, piece[k])
            out += emitted
            k += 1
        state = self.states[number]
        while len(piece) - k > FAR_END:
            state, emitted = self.step(state, piece[k])
            out += emitted
            k += 1
        at, last, ids = state
        read = [*ids]
        for b in piece[k:]:
            at = self.place(at, b)
            read.append(self.ending(at, last, read))
        return (*out, *self.path(read)[::-1])


class Encoder:
    """Ids of texts: pieces of the pattern, each by the transducer or from a bounded table of pieces met before."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.transducer = Transducer(read_ranks(path))
        self.pattern, self.border = regex.compile(pattern), regex.compile(r"(?<=\S)\s")
        self.western = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{LETTER}{DIGIT}]").replace(r"\p{L}", f"[{LETTER}]").replace(r"\p{N}", f"[{DIGIT}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.known: dict[str, tuple[int, ...]] = {}

    def cuts(self, text: str) -> Iterator[str]:
        """Parts of a long text, cut where white space follows another character: no piece goes on over such a place."""
        at = 0
        while len(text) - at > AT_ONCE and (found := self.border.search(text, at + AT_ONCE)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def ids(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text. Pieces of AT_ONCE characters go together: new ones in order, so that they share the states of what they begin with."""
        out: list[list[np.ndarray]] = []
        group: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            out.append([])
            for part in self.cuts(text or ""):
                group.append((k, (self.pattern if WIDE.search(part) else self.western).findall(part)))
                size += len(part)
                if size >= AT_ONCE:
                    self._look_up(group, out)
                    group, size = [], 0
        self._look_up(group, out)
        return [np.concatenate(x) if x else np.empty(0, np.int32) for x in out]

    def _look_up(self, group: list[tuple[int, list[str]]], out: list[list[np.ndarray]]) -> None:
        known = self.known
        new = {p for _, pieces in group for p in pieces if p not in known}
        if len(known) + len(new) > PIECES:
            known.clear()
            new = {p for _, pieces in group for p in pieces}
        for p in sorted(new):
            known[p] = self.transducer.encode(p.encode())
        for k, pieces in group:
            out[k].append(np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), np.int32))


def _machine() -> np.ndarray:
    """Next state by state and byte of UTF-8. 0 between characters; 1 to 3 that many bytes to come; 4 to 7 the second byte after E0, ED, F0, F4.

    A byte that doesn't fit ends the malformed character and is read anew from state 0; a byte that can't begin one leaves state 0.
    """
    start = np.zeros(256, np.uint8)
    for lo, hi, to in ((0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEF, 2), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7)):
        start[lo : hi + 1] = to
    out = np.tile(start, (8, 1))
    for state, lo, hi, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        out[state, lo : hi + 1] = to
    return out


class Tokens:
    """The bytes of all tokens in one flat table, and the UTF-8 machine's next state by state and token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        n = max(ranks.values(), default=-1) + 1
        by_id = [b""] * n
        for t, i in ranks.items():
            by_id[i] = t
        self.size = np.array([len(t) for t in by_id], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(by_id) or b"\0", np.uint8)
        machine, self.next = _machine(), np.tile(np.arange(8, dtype=np.uint8)[:, None], (1, n))
        for k in range(int(self.size.max(initial=0))):
            has = np.flatnonzero(self.size > k)
            self.next[:, has] = machine[self.next[:, has], self.flat[self.first[has] + k]]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.first[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class Stream:
    """Text of ids that arrive part by part: what isn't a whole character yet waits for the next part. Malformed bytes become U+FFFD."""

    def __init__(self, tokens: Tokens) -> None:
        self.tokens, self.state, self.held = tokens, 0, b""

    def push(self, ids: np.ndarray) -> str:
        if ids.size and (ids.min() < 0 or ids.max() >= len(self.tokens.size)):
            raise ValueError("an id lies outside the vocabulary")
        s, step, at = self.state, self.tokens.next, 0
        for k in np.append(np.flatnonzero(step[0, ids]), len(ids)).tolist():  # ids that leave a character open; others matter only while one is open
            while s and at < k:
                s = int(step[s, ids[at]])
                at += 1
            if k < len(ids) and at <= k:
                s, at = int(step[s, ids[k]]), k + 1
        self.state = s
        raw = self.held + self.tokens.bytes_of(ids)
        cut = len(raw)
        if s:
            cut = max(k for k in range(max(0, len(raw) - 3), len(raw)) if raw[k] >= 0xC0)
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        left, self.state, self.held = self.held, 0, b""
        return left.decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, pattern)


@lru_cache(2)
def tokens_of(path: str) -> Tokens:
    return Tokens(read_ranks(path))


@contextmanager
def _no_collections() -> Iterator[None]:
    """Tables of states are long lived: collecting garbage over and over while they grow takes longer than making them."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def stream_text(tokens: Tokens, ids: np.ndarray) -> str:
    """The text of ids, pushed through a stream part by part."""
    stream = Stream(tokens)
    return "".join([*(stream.push(ids[at : at + CHUNK]) for at in range(0, len(ids), CHUNK)), stream.close()])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id_col and ids (array of int) of every row, by a file of ranks. No special tokens: their strings are ordinary text.

    decoded: also what the ids decode to, in the same task: one worker then holds the tables of both.

    A null text has no ids, like an empty one; null ids and repeated rows stay as they are; other columns, whatever their names, don't
    matter; an empty table has no rows. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            with _no_collections():
                ids = own.ids(text.as_py() for text in b.column(1))
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            columns = [b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
            if decoded:
                columns.append(pa.array([stream_text(tokens_of(path), x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of ids_col in its place, as `out`: ids are pushed through a stream part by part. Null ids give an empty text."""
    others = [c for c in encoded.columns if c != ids_col]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for b in batches:
            lists, texts = b.column(len(others)), []
            for k in range(len(lists)):
                ids = lists[k].values
                texts.append(stream_text(tokens, np.empty(0, np.int64) if ids is None else ids.to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(texts, pa.string())], [*others, out])

    return encoded.select(*[F.col(f"`{c}`") for c in others], ids_col).mapInArrow(run, f"{schema}, `{out}` string")


def encoded_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    both = encode(docs, path, pattern, decoded=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(joined).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))

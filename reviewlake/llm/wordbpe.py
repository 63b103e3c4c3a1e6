"""Ids of the public word-end BPE vocabulary for batches of texts, by array operations on their bytes.

The tokenizer drops white space, keeps letters, digits and marks apart, and never merges across these
borders. So texts are cut at white space and around lone full stops and commas, the cuts are told apart by
64-bit hashes of their bytes, only cuts not met before go to the tokenizer (many in one call), and the ids
of all are gathered from one flat table. The table is bounded: when full it starts anew.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np

from reviewlake.llm.words import cut

#: Cuts in the table, and bytes that are worked on at once.
TABLE, BATCH = 1_000_000, 1_500_000

_PLAIN = re.compile("[\x21-\x7eÀ-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class WordBpe:
    def __init__(self, path: str, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.special_as_text = special_as_text
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.first, self.count = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, cuts: list[bytes]) -> list[list[int]]:
        """The ids of each cut: pieces of plain ones in few long calls, odd ones one by one."""
        parts: list[list[str] | None] = []
        for w in cuts:
            s = w.decode()
            parts.append(_PIECE.findall(s.lower()) if _PLAIN.fullmatch(s) and "<|" not in s else None)
        out: list[list[int]] = [[] for _ in cuts]
        plain = [k for k, p in enumerate(parts) if p is not None]
        for at in range(0, len(plain), 4096):
            group = plain[at : at + 4096]
            ids = self._encode([" ".join(chain.from_iterable(parts[k] for k in group))])[0]
            ends = (np.flatnonzero(self.last[np.array(ids, np.int64)]) + 1).tolist()
            ends.insert(0, 0)
            here = 0
            for k in group:
                out[k] = ids[ends[here] : ends[here + len(parts[k])]]
                here += len(parts[k])
            assert here + 1 == len(ends)
        odd = [k for k, p in enumerate(parts) if p is None]
        for k, ids in zip(odd, self._encode([cuts[k].decode() for k in odd]) if odd else [], strict=True):
            out[k] = ids
        return out

    def _learn(self, hashes: list[int], cuts: list[bytes]) -> None:
        new = self._ids(cuts)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        at, total = len(self.rows), int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while at + len(new) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(new), np.uint32, total)
        self.first[at : at + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.count[at : at + len(new)] = sizes
        self.used += total
        self.rows.update(zip(hashes, range(at, at + len(new)), strict=True))

    def _batch(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = b"\n" + b"\n".join(texts) + b"\n"
        if self.special_as_text or b"<|" not in raw:
            raw = raw.lower()  # of bytes: A-Z alone
        starts, ends, hashes = cut(raw, True)
        different, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.rows) + len(different) > TABLE:
            self._clear()
        keys = different.tolist()
        rows = np.fromiter((self.rows.get(k, -1) for k in keys), np.int64, len(keys))
        if len(unseen := np.flatnonzero(rows < 0)):
            spots = where[unseen]
            self._learn([keys[k] for k in unseen.tolist()], [raw[s:e] for s, e in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)])
            rows[unseen] = np.arange(len(self.rows) - len(unseen), len(self.rows))
        size = self.count[rows][back]
        through = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[rows][back] - through + size, size) + np.arange(through[-1] if len(through) else 0)]
        after = np.cumsum([len(t) + 1 for t in texts])  # where the white space after each text stands
        words = np.searchsorted(starts, after)
        return np.split(ids, np.concatenate(([0], through))[words][:-1])

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text, as the tokenizer gives them for the whole text."""
        out: list[np.ndarray] = []
        part: list[bytes] = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= BATCH:
                out += self._batch(part)
                part, size = [], 0
        return out + self._batch(part) if part else out


@lru_cache(4)
def word_bpe(path: str, special_as_text: bool = False) -> WordBpe:
    """One encoder for each worker process."""
    return WordBpe(path, special_as_text)

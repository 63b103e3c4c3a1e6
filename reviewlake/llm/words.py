"""Words of UTF-8 bytes and their 64-bit hashes, by array operations: white space is exactly space and 09 to 0D."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BYTES = np.arange(256)
_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_ALONE = _SPACE | np.isin(_BYTES, list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


@lru_cache(3)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(1 << bits, _BASE), np.full(1 << bits, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def cut(raw: bytes, lone_marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of bytes that begin and end with white space.

    lone_marks: a full stop or comma between two of letter, digit and white space is a word of its own.
    """
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    inside = ~space
    if lone_marks:
        alone = _ALONE[b]
        mark = (b == 0x2E) | (b == 0x2C)
        mark[1:-1] &= alone[:-2] & alone[2:]
        edge = mark | space
        starts = np.flatnonzero(inside[1:] & (edge[:-1] | mark[1:])) + 1
        ends = np.flatnonzero(inside[:-1] & (edge[1:] | mark[:-1])) + 1
    else:
        starts = np.flatnonzero(inside[1:] & space[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & space[1:]) + 1
    up, down = _powers(max(18, len(b).bit_length()))
    sums = np.cumsum(_VALUE[b] * up[: len(b)], dtype=np.uint64)
    h = (sums[ends - 1] - sums[starts - 1]) * down[starts]
    return starts, ends, h ^ (h >> np.uint64(29))

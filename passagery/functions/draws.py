"""Draws by MD5 for many texts at once: prefix + number, hashed in arrays."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np

_SHIFT = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADD = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts hashed together; their arrays stay in the processor's cache.
LANES = 16_384


def head(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first 48 bits of the MD5 of n texts of one block each; words: the 16 little-endian 32-bit words, padded as MD5 does, a number where all texts have the same."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:  # d ^ (b & (c ^ d))
            g = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        same = isinstance(words[g], int)
        np.add(f, a, out=f), np.add(f, np.uint32((_ADD[i] + words[g]) & 0xFFFFFFFF if same else _ADD[i]), out=f)
        if not same:
            np.add(f, words[g], out=f)
        s = _SHIFT[turn][i % 4]
        np.left_shift(f, np.uint32(s), out=t), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    first, second = a + np.uint32(_START[0]), b + np.uint32(_START[1])
    return (first.byteswap().astype(np.uint64) << np.uint64(16)) | (second.byteswap() >> np.uint32(16)).astype(np.uint64)


@functools.lru_cache(256)
def _digits(lo: int, hi: int) -> np.ndarray:
    """The digits of the numbers from lo to before hi, all of one length, a row each."""
    d, n = np.arange(lo, hi), len(str(lo))
    out = np.empty((hi - lo, n), np.uint8)
    for i in range(n):
        out[:, n - 1 - i] = 48 + d % 10
        d //= 10
    return out


def drawn(prefix: str, total: int) -> Iterator[np.ndarray]:
    """For each number d below total the first 12 hex digits of md5(prefix + d), modulo total; in arrays, in order."""
    own = prefix.encode()
    lo = 0
    while lo < total:
        digits = len(str(lo))
        hi = min(lo + LANES, total, 10**digits)
        size = len(own) + digits
        if size > 55:
            raise ValueError("a draw's text must fit one block of MD5")
        whole, width = len(own) // 4, -(-(size + 1) // 4)  # words of the prefix alone, words up to the text's end
        text = np.zeros((hi - lo, 4 * (width - whole)), np.uint8)
        rest = len(own) - 4 * whole
        text[:, :rest] = np.frombuffer(own[4 * whole :], np.uint8)
        text[:, rest : rest + digits] = _digits(lo, hi)
        text[:, rest + digits] = 0x80
        words = [int.from_bytes(own[4 * i : 4 * i + 4], "little") for i in range(whole)] + list(np.ascontiguousarray(text.view("<u4").T))
        words += [0] * (14 - width) + [8 * size, 0]
        yield (head(words, hi - lo) % np.uint64(total)).astype(np.int64)
        lo = hi

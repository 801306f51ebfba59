"""The hash draws of ``functions.draws`` for whole vectors at a time.

Draw (seed, replicate, slot) is the first word of an MD5 sum. In expressions a draw is a row,
with texts around it; here a task takes some replicates and reckons MD5 for blocks of slots
in whole arrays of 32-bit words, with the vector that is drawn from at hand.
"""

from __future__ import annotations

import math

import numpy as np

_K = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_R = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in row]
BLOCK = 1 << 15


def md5_words(words: list) -> np.ndarray:
    """First word of the MD5 sum of messages of one block; ``words`` are 16, arrays or numbers."""
    size = next(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(size, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, low = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        w = words[g]
        if isinstance(w, np.ndarray):
            a += w
            a += np.uint32(_K[i])
        else:
            a += np.uint32((w + _K[i]) & 0xFFFFFFFF)
        a += f
        np.left_shift(a, np.uint32(_R[i]), out=low)
        a >>= np.uint32(32 - _R[i])
        a |= low
        a += b
        a, b, c, d = d, a, b, c
    return a + np.uint32(0x67452301)


def words_of(prefix: bytes, lo: int, hi: int) -> np.ndarray:
    """The draws' words for slots lo .. hi - 1, which have equally many digits."""
    digits = len(str(lo))
    length = len(prefix) + digits
    if length > 55:
        raise ValueError("a draw's text is longer than a block")
    text = np.zeros((hi - lo, 4 * (length // 4 + 1)), dtype=np.uint8)
    text[:, : len(prefix)] = np.frombuffer(prefix, dtype=np.uint8)
    left = np.arange(lo, hi)
    for k in range(digits):
        left, digit = np.divmod(left, 10)
        text[:, length - 1 - k] = digit + 48
    text[:, length] = 128
    each = text.view("<u4")
    words: list = [0] * 16
    for k in range(each.shape[1]):
        words[k] = np.ascontiguousarray(each[:, k])
    if isinstance(words[14], np.ndarray):
        raise ValueError("a draw's text is longer than a block")
    words[14] = 8 * length
    return md5_words(words).byteswap()


def draws(seed: int, replicate: int, n: int):
    """(first slot, words) of all slots 0 .. n - 1, block by block."""
    prefix, lo = f"{seed}|{replicate}|".encode(), 0
    while lo < n:
        hi = min(n, lo + BLOCK, 10 ** len(str(lo)))
        yield lo, words_of(prefix, lo, hi)
        lo = hi

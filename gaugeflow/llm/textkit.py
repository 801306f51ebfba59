"""Vectorised text kernels that the operators of this subpackage share.

A *word* is a maximal run of ASCII letters, digits and non-ASCII bytes of the
lower-cased UTF-8 text; every other byte separates words. A null text counts as
an empty one. All functions take whole Arrow string arrays, so the cost per word
is a few nanoseconds of numpy instead of a Python call.

Hashes are polynomial with an odd multiplier modulo 2**64, taken from prefix
sums (an odd multiplier has an inverse, so any substring's hash is a difference
of two prefix sums times a power) and then mixed by a murmur finaliser.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F
CHUNK_BYTES, BLOCK = 1 << 20, 1 << 20

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[ord("A") : ord("Z") + 1] = True
_IS_WORD[128:] = True


def fmix64(x: np.ndarray) -> np.ndarray:
    """Murmur finaliser, elementwise; a bijection of 64-bit values."""
    x = np.atleast_1d(x)
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, base, dtype=U)
    up[0] = 1
    down = np.full(size, pow(base, -1, 1 << 64), dtype=U)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(base: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (need - 1).bit_length())
    return _powers(base, size)


@dataclass
class Words:
    """The words of a batch. ``hashes`` is in text order; the words of text i are
    ``hashes[offsets[i]:offsets[i + 1]]``."""

    hashes: np.ndarray
    offsets: np.ndarray
    prefixes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def as_array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column


def utf8_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the batch and the offset at which each text begins."""
    texts = pc.fill_null(as_array(texts), "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", limit: int = 2 << 20):
    """The record batches in slices of whole rows of about ``limit`` bytes of text, which
    bounds a worker's memory whatever the rows of a batch."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b[column]), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield b.slice(at, end - at)
            at = end


def lowered(texts) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(as_array(texts), ""))


def _cut(raw: np.ndarray, at: int, end: int) -> int:
    """The first byte from ``at`` on that is in no word."""
    while at < end:
        found = np.flatnonzero(~_IS_WORD[raw[at : min(end, at + (1 << 16))]])
        if len(found):
            return at + int(found[0])
        at += 1 << 16
    return end


def pieces(texts):
    """(i, j, part): the texts i to j - 1 where they are short, in runs of about
    CHUNK_BYTES, so that what is made of them stays in cache; a long text in several parts
    (j = i + 1), cut where no word is."""
    texts = pc.fill_null(as_array(texts), "").cast(pa.large_string())
    raw, offsets = utf8_bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        at, end = int(offsets[i]), int(offsets[i + 1])
        if end - at <= 2 * CHUNK_BYTES:
            j = max(i + 1, int(np.searchsorted(offsets, at + CHUNK_BYTES, side="right")) - 1)
            yield i, j, texts.slice(i, j - i)
            i = j
            continue
        while at < end:
            to = _cut(raw, at + CHUNK_BYTES, end) if end - at > 2 * CHUNK_BYTES else end
            yield i, i + 1, pa.array([raw[at:to].tobytes()], pa.large_binary()).cast(pa.large_string())
            at = to
        i += 1


def words(texts, lower: bool = True, prefix: int = 0) -> Words:
    """Hashes of all words of a batch of texts, and of their first ``prefix`` bytes if
    that is not 0."""
    texts = as_array(texts)
    out, heads, counts = [], [], np.zeros(len(texts), dtype=np.int64)
    for i, j, part in pieces(texts):
        piece, offsets = utf8_bytes(lowered(part) if lower else part)
        size = len(piece)
        if not size:
            continue
        flags = np.zeros(size + 2, dtype=np.int8)
        flags[1:-1] = _IS_WORD[piece]
        edge = np.diff(flags)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # a word that runs over the border of two texts is two words
        bounds = offsets[1:-1]
        inner = bounds[(bounds > 0) & (bounds < size)]
        cut = np.unique(inner[flags[inner].astype(bool) & flags[inner + 1].astype(bool)])
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        if not len(starts):
            continue
        up, down = powers(_BYTE_BASE, size + 1)
        sums = np.empty(size + 1, dtype=U)
        sums[0] = 0
        np.cumsum((piece.astype(U) + U(1)) * up[:size], out=sums[1:])
        out.append(fmix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)))
        if prefix:
            stop = np.minimum(ends, starts + prefix)
            heads.append(fmix64((sums[stop] - sums[starts]) * down[starts] + U(1 << 32)))
        text = np.searchsorted(offsets, starts, side="right") - 1
        counts[i:j] += np.bincount(text, minlength=j - i)[: j - i]
    hashes = np.concatenate(out) if out else np.zeros(0, U)
    prefixes = (np.concatenate(heads) if heads else np.zeros(0, U)) if prefix else None
    return Words(hashes, np.concatenate([[0], np.cumsum(counts)]), prefixes)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` consecutive entries (over text borders too:
    callers mask those with ``window_starts``)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, dtype=U)
    step = max(1 << 16, 4 * length)
    for at in range(0, n, step):
        end = min(n, at + step)
        part = hashes[at : end + length - 1]
        up, down = powers(_WORD_BASE, len(part) + 1)
        sums = np.empty(len(part) + 1, dtype=U)
        sums[0] = 0
        np.cumsum((part | U(1)) * up[: len(part)], out=sums[1:])
        out[at:end] = (sums[length:] - sums[:-length]) * down[: len(part) - length + 1]
    return fmix64(out)


def window_starts(counts: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Global index of every window that lies within one text, and its text."""
    each = np.maximum(counts - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), each)
    first = np.cumsum(each) - each
    return np.arange(int(each.sum())) - np.repeat(first, each) + np.repeat(offsets[:-1], each), text


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def minimizers(values: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Indices of the values that are least in some run of ``width`` neighbours of one
    text (in the whole text, if that has fewer). Equal least values are all chosen,
    which only adds fingerprints. ``text`` must be non-decreasing."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    if width <= 1:
        return np.arange(n)
    if n > 2 * BLOCK:  # in blocks with width - 1 neighbours either way, which hold every run of their values
        out = []
        for at in range(0, n, BLOCK):
            lo, hi = max(0, at - width + 1), min(n, at + BLOCK + width - 1)
            found = lo + minimizers(values[lo:hi], text[lo:hi], width)
            out.append(found[(found >= at) & (found < at + BLOCK)])
        return np.concatenate(out)
    top = U(0xFFFFFFFFFFFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    # texts apart by width - 1 fillers, and filled up to one full run where shorter
    room = np.maximum(size, width) + width - 1
    at = np.concatenate([[0], np.cumsum(room)])
    index = np.arange(n) - np.repeat(first, size) + np.repeat(at[:-1], size)
    spaced = np.full(at[-1], top, dtype=U)
    spaced[index] = values
    least = sliding_min(spaced, width)
    # a run counts only if it begins in the text and ends in it (or is its only one)
    valid = np.zeros(len(least), dtype=bool)
    runs = np.maximum(size - width + 1, 1)
    starts = np.repeat(at[:-1], runs) + np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    valid[starts] = True
    masked = np.where(valid, least, U(0))
    padded = np.concatenate([np.zeros(width - 1, U), masked, np.zeros(max(0, at[-1] - len(masked)), U)])
    most = ~sliding_min(~padded, width)
    return np.flatnonzero(most[index] == values)


def word_list(text: str | None) -> list[bytes]:
    """The words of one text, by the same rule, one by one (for tests and reports)."""
    import re

    return re.findall(rb"[0-9a-zA-Z\x80-\xff]+", pc.utf8_lower(pa.scalar(text or "")).as_py().encode())

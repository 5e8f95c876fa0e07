"""Vectorised word hashing on batches of texts.

Whole batches are one byte buffer, so the work per word is a handful of NumPy passes and no Python object is
made for a word. Long buffers are done in blocks cut at separators, which bounds the scratch arrays by
``BLOCK`` whatever the length of a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: The bytes between words, [\x20\x09-\x0D].
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD_INVERSE = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; at least n of them."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base, np.uint64)
        steps[0] = 1
        have = _POWERS[int(base)] = np.cumprod(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_values(fold_case: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; with ``fold_case`` A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if fold_case:
        values[65:91] = values[97:123]
    return values


def spaces_mask() -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(SPACES)] = True
    return mask


def portions(sizes: list[int], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts to be done at once: of ``most`` bytes together, or of one longer text. Scratch arrays take some 50 bytes a byte."""
    a = total = 0
    for i, size in enumerate(sizes):
        if i > a and total + size > most:
            yield a, i
            a, total = i, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def release() -> None:
    """Give what a task has freed back to the system. Workers live on beside later stages, and the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


@dataclass
class Words:
    """The words of a batch of texts: hash, byte span in ``data``, and where each text's words begin."""

    data: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  #: words bounds[i]:bounds[i + 1] are those of text i

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def hash_words(texts: list[bytes | None], separators: np.ndarray | None = None, values: np.ndarray | None = None) -> Words:
    """Words of every text, as maximal runs of bytes that are no separators. A null text has none.

    The separators must include the line feed, which is put between texts.
    """
    separators = spaces_mask() if separators is None else separators
    values = byte_values() if values is None else values
    texts = [t or b"" for t in texts]
    data = b"\n".join(texts) + b"\n"
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = np.frombuffer(data, np.uint8)
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(raw):
        to = min(at + BLOCK, len(raw))
        while to < len(raw) and not separators[raw[to - 1]]:  # a word is never cut
            cut = np.flatnonzero(separators[raw[to : to + BLOCK]])
            to = to + int(cut[0]) + 1 if len(cut) else min(to + BLOCK, len(raw))
        block = raw[at:to]
        gap = separators[block]
        edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(values[block] * powers(_BASE, len(block))[: len(block)], out=total[1:])
        hashes.append(mix((total[end] - total[begin]) * powers(_INVERSE, len(block) + 1)[begin]))
        starts.append(begin + at)
        ends.append(end + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
    return Words(data, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), start, np.concatenate(ends) if ends else start, bounds)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return range_hashes(hashes, np.arange(n), np.arange(size, size + n))


def range_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of words begin[i]:end[i], for each i: the same for the same words, wherever they are."""
    if not len(hashes) or not len(begin):
        return np.zeros(len(begin), np.uint64)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_WORD_BASE, len(hashes))[: len(hashes)], out=total[1:])
    found = (total[end] - total[begin]) * powers(_WORD_INVERSE, len(hashes) + 1)[begin]
    return mix(found + (end - begin).astype(np.uint64))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` consecutive values, by doubling."""
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = size - span
    return np.minimum(x[:n], x[rest : rest + n]) if rest else x[:n]

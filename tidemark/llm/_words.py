"""Hashes of the words of many texts at once, by numpy over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  #: odd, so that its powers can be divided by
CHUNK = 256 << 10  #: bytes that are hashed together


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Kind:
    """What words are: a table that puts bytes in lower case, and which bytes part words."""

    def __init__(self, apart: list[int]):
        self.lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
        self.space = np.zeros(256, bool)
        self.space[apart] = True


#: ``[^\\x20\\x09-\\x0D]+`` and ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, both after lower-casing A-Z.
SPACED = Kind([0x20, *range(0x09, 0x0E)])
ALNUM = Kind([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (modulo 2**64), at least ``n`` of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _hashes(data: np.ndarray, starts: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, length in bytes and text of every word of texts that lie one after
    another in ``data``, each from its place in ``starts`` (strictly ascending)."""
    data = kind.lower[data]
    word = ~kind.space[data]
    before = np.concatenate([[False], word[:-1]])
    before[starts] = False
    begin = np.flatnonzero(word & ~before)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    after = np.concatenate([word[1:], [False]])
    after[starts[1:] - 1] = False
    end = np.flatnonzero(word & ~after) + 1
    power, inverse = _powers_to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
    size = end - begin
    return mix((sums[end] - sums[begin]) * inverse[begin] + size.astype(np.uint64) * M2), size, np.searchsorted(starts, begin, side="right") - 1


def _cuts(data: np.ndarray, start: int, end: int, kind: Kind) -> Iterator[tuple[int, int]]:
    """A text in parts of about CHUNK bytes, cut between words."""
    while end - start > CHUNK:
        cut = start + CHUNK
        while cut < end and not kind.space[data[cut]]:
            cut += 1
        yield start, cut
        start = cut
    yield start, end


def words_of(texts: pa.Array, kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts that lie together, in order: hashes and lengths in bytes of all
    their words, and how many words each text has. Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + CHUNK, side="right")) - 1)
        if ends[j] - ends[i] > CHUNK:  # a long text, alone
            parts = [_hashes(data[a:b], np.zeros(1, np.int64), kind) for a, b in _cuts(data, int(ends[i]), int(ends[j]), kind)]
            h, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            counts = np.array([len(h)])
        else:
            at = ends[i:j] - ends[i]
            full = np.flatnonzero(ends[i + 1 : j + 1] > ends[i:j])  # texts with bytes, whose starts differ
            counts = np.zeros(j - i, np.int64)
            h, size = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if len(full):
                h, size, text = _hashes(data[ends[i] : ends[j]], at[full], kind)
                counts[full] = np.bincount(text, minlength=len(full))
        yield h, size, counts
        i = j

"""Words of a text as 64-bit numbers, and numbers of sequences of them."""

from __future__ import annotations

import numpy as np

from .common import mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of _BASE, wrapping."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def split_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: bytes.split() cuts at the six characters that end a word, and only there."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def batch_numbers(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number of each word of all texts in order, and how many words each text has."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join(raws), np.uint8)
    starts, ends = word_bounds(raw)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    length = ends - starts
    own = _BYTE[raw[~_SPACE[raw]]]
    first = np.cumsum(length) - length
    place = np.arange(len(own)) - np.repeat(first, length)
    numbers = mix(np.add.reduceat(own * powers(int(length.max()))[place], first) + length.astype(np.uint64))
    begin = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return numbers, np.diff(np.searchsorted(starts, begin))


def word_numbers(text: str | None) -> np.ndarray:
    """A 64-bit number of each word of one text."""
    return batch_numbers([text])[0]


def with_separators(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a separator before, between and after texts; where separators stand; where each text's words begin."""
    text = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(len(numbers) + len(counts) + 1, np.uint64)
    out[np.arange(len(numbers)) + text + 1] = numbers
    bars = np.concatenate([[0], np.cumsum(counts) + np.arange(1, len(counts) + 1)])
    separator = np.zeros(len(out), bool)
    separator[bars] = True
    return out, separator, bars[:-1] + 1


def sequence_numbers(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number of each run of n consecutive words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = words[:count].copy()
    for k in range(1, n):
        total = total * _STEP + words[k : k + count]
    return mix(total)

"""Words of many texts at once, as numpy arrays: boundaries and 64-bit hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

CHARS_AT_ONCE = 1 << 18
NEWLINE = 10
#: An odd multiplier has an inverse modulo 2^64, so that a sum of powers can be shifted to start at the first one.
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), wrapping around."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


@lru_cache(1)
def word_characters() -> np.ndarray:
    r"""Which code points ``\w`` matches."""
    return np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def one_byte() -> tuple[bytes, bytes]:
    r"""For the code points below 256: their lower case, which lies there too, and 1 for those that ``\w`` matches in lower case."""
    lower = "".join(map(chr, range(256))).lower()
    return lower.encode("latin-1"), bytes(c == "_" or c.isalnum() for c in lower)


@lru_cache(1)
def character_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """``BASE`` and its inverse to the powers 0 to CHARS_AT_ONCE, modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(CHARS_AT_ONCE + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def power_at(place: np.ndarray) -> np.ndarray:
    """``BASE`` to the powers ``place``, however large."""
    up, most = powers()[0], int(place.max(initial=0)) // CHARS_AT_ONCE
    if not most:
        return up[place]
    high, steps = place // CHARS_AT_ONCE, np.full(most + 1, up[-1], np.uint64)
    steps[0] = 1
    return up[place % CHARS_AT_ONCE] * np.multiply.accumulate(steps)[high]


def hash_words(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word ``points[start:end]``: words of about CHARS_AT_ONCE characters at once, and a longer one in parts, so
    that what is held beside the points and the words does not grow with a text."""
    (up, down), values = powers(), character_values()
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        first = start[i]
        j = int(np.searchsorted(end, first + CHARS_AT_ONCE, side="right"))
        if j > i:
            part = points[first : end[j - 1]]
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.take(values, part, out=total[1:], mode="clip")  # no code point lies outside; without a mode the result is copied
            total[1:] *= up[: len(part)]
            np.cumsum(total[1:], out=total[1:])
            a, b = start[i:j] - first, end[i:j] - first
            out[i:j] = (total[b] - total[a]) * down[a]
        else:
            j, scale, total = i + 1, up[:1], np.zeros(1, np.uint64)
            for at in range(int(first), int(end[i]), CHARS_AT_ONCE):
                part = points[at : min(at + CHARS_AT_ONCE, int(end[i]))]
                total = total + scale * (values[part] * up[: len(part)]).sum(dtype=np.uint64)
                scale = scale * up[CHARS_AT_ONCE:]
            out[i] = total[0]
        i = j
    return mix(out + (end - start).astype(np.uint64))


class Words:
    """Words of some texts: ``hashes`` of all, ``start`` and ``end`` in ``points``, and the line and text that each is in.

    ``points`` are the code points of the lower-case texts, each followed by one that is in no word; a byte each if all are below 256.
    """

    def __init__(self, texts: list[str]):
        try:
            lower, is_word = one_byte()
            raw = "\n".join([*texts, ""]).encode("latin-1").translate(lower)
            self.points, inside = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(is_word), bool)
        except UnicodeEncodeError:
            texts = [t.lower() for t in texts]
            self.points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
            inside = word_characters()[self.points]
        # words begin and end in turn, as the last point is in no word
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.concatenate([[0], edge]) if len(inside) and inside[0] else edge
        self.start, self.end = edge[::2], edge[1::2]
        self.text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.hashes = hash_words(self.points, self.start, self.end)

    def per_text(self) -> np.ndarray:
        """How many words each text has."""
        return np.diff(np.searchsorted(self.start, self.text_end), prepend=0)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each line with a word: the text it is in, its number there, and how many words it has."""
        ends = np.flatnonzero(self.points == NEWLINE)  # a text ends its last line
        counts = np.diff(np.searchsorted(self.start, ends), prepend=0)
        text = np.searchsorted(self.text_end, ends, side="right")
        first = np.searchsorted(ends, self.text_end[:-1] - 1) + 1
        number = np.arange(len(ends)) - np.concatenate([[0], first])[text]
        has = counts > 0
        return text[has], number[has], counts[has]


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHARS_AT_ONCE characters."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHARS_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)

"""Edit distance within a band, for sequences of words or characters."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def edits_within(a: Sequence[Hashable], b: Sequence[Hashable], most: int) -> int | None:
    """The edit distance of ``a`` and ``b`` if it is at most ``most``, else None.

    Only cells within ``most`` of the main diagonal are computed. A column of that band is held as two bit vectors (where
    the next cell down is one more, one less), and a step takes a few operations on integers of ``2 * most + 1`` bits.
    """
    if abs(len(a) - len(b)) > most:
        return None
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < end - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[start : len(a) - tail], b[start : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    most = min(most, len(b))
    if most == 0:
        return None
    # where[x]: bit i is set if a[i] == x
    where: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    width = 2 * most + 1
    mask = (1 << width) - 1
    # bit k of the band in column j is position j - most + k of a
    plus, minus = mask ^ ((1 << most) - 1), 0
    n, m = len(a), len(b)
    # The distance is followed down the lowest diagonal of the band as far as the last position of a, then along that.
    score = min(most, n)
    for j in range(m):
        low = j - most
        hit = where.get(b[j], 0)
        hit = (hit >> low if low >= 0 else hit << -low) & mask
        diagonal = ((((hit & plus) + plus) ^ plus) | hit | minus) & mask
        up = (minus | ~(diagonal | plus)) & mask
        down = diagonal & plus
        if j + most < n:
            score += 1 - (diagonal >> 2 * most & 1)
        else:
            last = n - 1 - low
            score += (up >> last & 1) - (down >> last & 1)
        if score > most + max(0, (m - j - 1)):
            return None
        shifted = diagonal >> 1
        plus = (down | ~(shifted | up)) & mask
        minus = shifted & up
    return score if score <= most else None

"""What ``difflib.SequenceMatcher(None, a, b, autojunk=False)`` matches, block for block, without its quadratic time.

It takes the longest common stretch (of equal ones the first in ``a``, then the first in ``b``) and goes on left and
right of it. Here long stretches are found once for both texts, by hashes of ``SEED`` characters, and clipped to each
box; only boxes without one are searched, with ``str.find``.
"""

from __future__ import annotations

import numpy as np

SEED = 16
#: Equal seeds a character, over both texts, beyond which texts repeat themselves too much for a list of pairs.
MOST_PAIRS = 16


def longest(a: str, alo: int, ahi: int, b: str, blo: int, bhi: int) -> tuple[int, int, int]:
    """(i, j, size) of the longest common stretch of ``a[alo:ahi]`` and ``b[blo:bhi]``; looks for pieces of the shorter in the other."""
    i, j, size = alo, blo, 0
    if ahi - alo <= bhi - blo:
        for x in range(alo, ahi):
            if x + size >= ahi:
                break
            while x + size < ahi and (at := b.find(a[x : x + size + 1], blo, bhi)) >= 0:
                i, j, size = x, at, size + 1
        return i, j, size
    for y in range(blo, bhi):
        least = size or 1
        if y + least > bhi:
            break
        if (at := a.find(b[y : y + least], alo, ahi)) < 0:
            continue
        if size and at < i:
            i, j = at, y
        elif not size:
            i, j, size = at, y, 1
        while y + size < bhi and (at := a.find(b[y : y + size + 1], at, ahi)) >= 0:
            i, j, size = at, y, size + 1
    return i, j, size


def _seeds(text: str) -> np.ndarray:
    """A hash of the ``SEED`` characters from each place on."""
    h, k = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), 1
    while k < SEED:
        h = h[:-k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        k *= 2
    return h


def common_runs(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(start in ``a``, start in ``b``, size) of all common stretches of at least ``SEED`` characters that can't be made longer; None if there are too many."""
    none = np.empty(0, np.int64)
    if min(len(a), len(b)) < SEED:
        return none, none, none
    x, y = _seeds(a), _seeds(b)
    order = np.argsort(y)
    y = y[order]
    first = np.searchsorted(y, x)
    maybe = np.flatnonzero(y[np.minimum(first, len(y) - 1)] == x)
    first = first[maybe]
    count = np.searchsorted(y, x[maybe], "right") - first
    total = int(count.sum())
    if total > MOST_PAIRS * (len(a) + len(b)):
        return None
    i = np.repeat(maybe, count)
    j = order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(total)]
    pairs = np.sort((j - i + len(a) << 32) + i)  # by diagonal, along it
    starts = np.flatnonzero(np.diff(pairs, prepend=-2) != 1)
    i = pairs[starts] & 0xFFFFFFFF
    j = i + (pairs[starts] >> 32) - len(a)
    size = np.diff(starts, append=total) + SEED - 1
    if any(a[p : p + n] != b[q : q + n] for p, q, n in zip(i.tolist(), j.tolist(), size.tolist())):
        return None  # equal hashes of unequal characters
    return i, j, size


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(i, j, size) of the matched blocks, in order; blocks that touch are not joined."""
    runs, out = common_runs(a, b), []
    boxes = [(0, len(a), 0, len(b), runs)]
    while boxes:
        alo, ahi, blo, bhi, runs = boxes.pop()
        size = 0
        if runs is not None and min(ahi - alo, bhi - blo) >= SEED:
            start, shift = runs[0], runs[1] - runs[0]
            start, end = np.maximum(start, np.maximum(alo, blo - shift)), np.minimum(start + runs[2], np.minimum(ahi, bhi - shift))
            inside = np.flatnonzero(end - start >= SEED)
            if len(inside):
                start, shift, sizes = start[inside], shift[inside], (end - start)[inside]
                runs = start, start + shift, sizes
                most = np.flatnonzero(sizes == sizes.max())
                k = most[np.argmin((start[most] << 32) + start[most] + shift[most])]
                i, j, size = int(start[k]), int(start[k] + shift[k]), int(sizes[k])
        if not size:
            runs = None  # nothing of SEED characters here, nor left and right of what is found
            i, j, size = longest(a, alo, ahi, b, blo, bhi)
        if size:
            out.append((i, j, size))
            if alo < i and blo < j:
                boxes.append((alo, i, blo, j, runs))
            if i + size < ahi and j + size < bhi:
                boxes.append((i + size, ahi, j + size, bhi, runs))
    return sorted(out)


def differences(a: str, b: str):
    """The opcodes other than ``equal``: (op, i, j, k, m), where ``a[i:j]`` became ``b[k:m]``."""
    i = k = 0
    for at, to, size in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if i < at or k < to:
            yield "replace" if i < at and k < to else "delete" if i < at else "insert", i, at, k, to
        i, k = at + size, to + size


def matched(a: str, alo: int, ahi: int, b: str, more_than: int = -1) -> int:
    """How many characters of ``a[alo:ahi]`` and ``b`` are matched; ``more_than`` or less once it can't be more."""
    boxes, could = [(alo, ahi, 0, len(b))], min(ahi - alo, len(b))
    while boxes and could > more_than:
        alo, ahi, blo, bhi = boxes.pop()
        i, j, size = longest(a, alo, ahi, b, blo, bhi)
        could += size - min(ahi - alo, bhi - blo)
        if size:
            if alo < i and blo < j:
                boxes.append((alo, i, blo, j))
                could += min(i - alo, j - blo)
            if i + size < ahi and j + size < bhi:
                boxes.append((i + size, ahi, j + size, bhi))
                could += min(ahi - i, bhi - j) - size
    return could


def best_window(haystack: str, needle: str, window: int, step: int, enough: float) -> float:
    """Best ratio of ``needle`` against windows of ``haystack``, of which the first above ``enough`` counts."""
    width, best = min(window, len(haystack)), 0
    total, last = width + len(needle), max(0, len(haystack) - window) // step * step
    if not needle:
        return 0.0
    ratio = lambda n: 2.0 * n / total
    if ratio(most := min(width, len(needle))) <= enough:  # then their order is free: first those that hold all of it
        at = haystack.find(needle)
        while at >= 0:
            if at + len(needle) <= min(at // step * step, last) + width:
                return ratio(most)
            at = haystack.find(needle, at + 1)
    for i in range(0, last + 1, step):
        best = max(best, matched(haystack, i, i + width, needle, best))
        if best == most or ratio(best) > enough:
            break
    return ratio(best)

"""Sampled suffixes of byte strings: which to keep, how to sort them, how to compare them.

Of all suffixes, those are kept that start at an anchor. Every window of ``WINDOW`` bytes chooses
its anchor from its own bytes alone, the start of the smallest-hashed run of ``GRAM`` bytes in it,
so equal windows choose the same one wherever they stand, and comparing the suffixes at anchors,
with what stands before them, compares all windows.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 50, 20
#: Starts of runs in a window, and the most bytes of a window before its anchor.
RUNS = WINDOW - GRAM + 1
LEFT = RUNS - 1
#: A frame: the suffix's first WINDOW bytes, the LEFT bytes before it (nearest first), and the
#: range of offsets of the windows that chose it.
FRAME = WINDOW + LEFT + 8
CHUNK = 1 << 17
#: Rows of a group that the sort no longer cuts by itself.
SMALL = 1 << 14
_POS = np.uint64((1 << 20) - 1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the documents that end at ``ends``: position, first and last window start, hash (44 bits).

    A window lies within one document. One anchor may come several times, once for each stretch of
    windows.
    """
    n = len(data)
    if n < WINDOW:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    total = n - WINDOW + 1
    cut = np.zeros(total, bool)  # windows that run over the end of their document
    for e in ends[:-1]:
        cut[max(0, e - WINDOW + 1) : e] = True
    found: list[tuple[np.ndarray, ...]] = []
    before = (-1, False)
    for s in range(0, total, CHUNK):
        m = min(CHUNK, total - s)
        raw = np.concatenate([data[s : s + m + WINDOW + 7], np.zeros(16, np.uint8)]).tobytes()
        w = np.empty(len(raw) - 7 & ~7, np.uint64)
        for j in range(8):
            w[j::8] = np.frombuffer(raw, "<u8", len(w) // 8, j)
        k = m + RUNS - 1
        h = w[:k] * _MIX[0] + w[8 : 8 + k] * _MIX[1] + w[GRAM - 8 : GRAM - 8 + k] * _MIX[2]
        h ^= h >> np.uint64(29)
        h *= _MIX[3]
        h ^= h >> np.uint64(32)
        h = (h & ~_POS) | np.arange(k, dtype=np.uint64)
        width = 1
        while 2 * width <= RUNS:
            h = np.minimum(h[: len(h) - width], h[width:])
            width *= 2
        best = np.minimum(h[:m], h[RUNS - width : RUNS - width + m])
        at, over = (best & _POS).astype(np.int64) + s, cut[s : s + m]
        new = np.ones(m, bool)
        new[0] = (at[0], over[0]) != before
        new[1:] = (at[1:] != at[:-1]) | (over[1:] != over[:-1])
        before = (at[-1], over[-1])
        i = np.flatnonzero(new)
        found.append((at[i], i + s, best[i] >> np.uint64(20), over[i]))
    at, first, key, over = (np.concatenate(x) for x in zip(*found))
    last = np.append(first[1:], total) - 1
    ok = ~over
    return at[ok], first[ok], last[ok], key[ok]


def frames(data: np.ndarray, pos: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One frame for each anchor; bytes outside its windows are zero."""
    step = np.r_[np.arange(WINDOW), -1 - np.arange(LEFT)]
    where = pos[:, None] + step
    inside = (where >= first[:, None]) & (where < (last + WINDOW)[:, None])
    out = np.zeros((len(pos), FRAME), np.uint8)
    out[:, : WINDOW + LEFT] = np.where(inside, data[np.where(inside, where, 0)], 0)
    out[:, -2], out[:, -1] = pos - last, pos - first
    return out


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows (width a multiple of 8), and where in it a row differs from the one before.

    Multikey quicksort, eight bytes a key: a group of rows that agree so far is cut into those below,
    equal to and above a pivot's next key; the equal ones go on with the key after it. Groups of up
    to SMALL rows are left for the end, where all of them are finished together, key by key.
    """
    n, words = len(rows), np.ascontiguousarray(rows).view(">u8")
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    depth = np.zeros(n, np.int64)  # keys in which a group is known to agree
    todo = [(0, n, 0)]
    while todo:
        lo, hi, d = todo.pop()
        depth[lo:hi] = d
        if hi - lo <= SMALL or d == words.shape[1]:
            continue
        own = order[lo:hi]
        key = words[own, d]
        pivot = np.sort(key[:: max(1, len(key) // 99)])
        pivot = pivot[len(pivot) // 2]
        below, above = key < pivot, key > pivot
        parts = own[below], own[~(below | above)], own[above]
        order[lo:hi] = np.concatenate(parts)
        for part, more in zip(parts, (0, 1, 0)):
            if len(part):
                new[lo] = True
                todo.append((lo, lo + len(part), d + more))
                lo += len(part)
    _finish(words, order, new, depth)
    return order, new


def _finish(words: np.ndarray, order: np.ndarray, new: np.ndarray, depth: np.ndarray) -> None:
    """Sort all groups of more than one row by the keys that are left of each."""
    for j in range(words.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied & (depth <= j))
        if not len(at):
            continue
        group = np.cumsum(new)[at]
        value = words[order[at], j].astype(np.uint64)
        by = np.lexsort((value, group))
        order[at] = order[at][by]
        value = value[by]
        same = ~new[at]
        same[1:] &= value[1:] == value[:-1]
        new[at] = ~same


def first_documents(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For frames and a document of each: bits[f] has bit o set if the window that starts o bytes
    before f's anchor is also in a document smaller than f's own.

    Equal frames are merged; frames that are alone with their first GRAM bytes are settled by that;
    for the others each window is compared byte by byte.
    """
    bits = np.zeros(len(rows), np.uint32)
    if not len(rows):
        return bits
    order, new = multikey_sort(rows)
    start = np.flatnonzero(new)
    kind = np.empty(len(rows), np.int64)
    kind[order] = np.cumsum(new) - 1
    u, least = rows[order[start]], np.minimum.reduceat(docs[order], start)
    low, high = u[:, -2].astype(int), u[:, -1].astype(int)
    whole = ((1 << (high + 1)) - (1 << low)).astype(np.uint32)
    head = np.ones(len(u), bool)
    head[1:] = (u[1:, :GRAM] != u[:-1, :GRAM]).any(1)
    alone = head & np.r_[head[1:], True]
    bits = np.where(alone[kind] & (least[kind] < docs), whole[kind], bits).astype(np.uint32)
    some = np.flatnonzero(~alone)
    if len(some):
        smallest = np.empty((len(some), RUNS), np.int64)
        smallest[:] = least[some, None]
        text = u[some]
        text = np.concatenate([text[:, WINDOW : WINDOW + LEFT][:, ::-1], text[:, :WINDOW]], axis=1)
        for o in range(RUNS):
            mine = np.flatnonzero((low[some] <= o) & (o <= high[some]))
            if len(mine) < 2:
                continue
            win = np.zeros((len(mine), -(-WINDOW // 8) * 8), np.uint8)
            win[:, :WINDOW] = text[mine, LEFT - o : LEFT - o + WINDOW]
            by, fresh = multikey_sort(win)
            edge = np.flatnonzero(fresh)
            got = np.minimum.reduceat(least[some[mine[by]]], edge)
            smallest[mine[by], o] = np.repeat(got, np.diff(np.append(edge, len(by))))
        place = np.full(len(u), -1)
        place[some] = np.arange(len(some))
        hit = np.flatnonzero(place[kind] >= 0)
        for k in range(0, len(hit), 1 << 16):
            f = hit[k : k + (1 << 16)]
            under = smallest[place[kind[f]]] < docs[f, None]
            bits[f] = (under @ (1 << np.arange(RUNS, dtype=np.int64))).astype(np.uint32) & whole[kind[f]]
    return bits

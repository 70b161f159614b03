"""Simple-8b word-aligned integer coding, vectorised.

A 64-bit word is a 4-bit selector and 60 bits of values. Values are coded in
blocks of BLOCK that start on a word boundary; the word offset of each block is
kept, so that blocks decode on their own. A value over 60 bits is escaped: an
escape word is followed by the raw value.
"""

from __future__ import annotations

import numpy as np

# Per selector, the values in a word and the bits of each. Selector 0 escapes.
COUNTS = [1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
BLOCK = 1024
LIMITS = np.array([(1 << b) - 1 for b in BITS[1:]], np.uint64)  # the largest value of each selector from 1


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, block offsets in words) of unsigned values."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    at = np.arange(n)
    end = np.minimum((at // BLOCK + 1) * BLOCK, n)
    # Which values fit a selector, by block, with room for the longest word; what lies past the end fits any.
    blocks = -(-n // BLOCK)
    fits = np.ones((blocks, BLOCK + max(COUNTS)), bool)
    best = np.zeros(blocks * BLOCK, np.int8)
    flat = np.zeros(blocks * BLOCK, np.int8)
    flat[:n] = np.searchsorted(LIMITS, v, side="left")  # the narrowest selector, from the widest end
    flat = flat.reshape(blocks, BLOCK)
    narrowest = flat.min()
    for s in range(15, 0, -1):  # the last that fits is the one with most values
        if s <= narrowest:
            break  # nothing is this narrow
        np.less_equal(flat, s - 1, out=fits[:, :BLOCK])
        run, width = fits, 1
        while width < COUNTS[s]:  # each place: whether it and the places up to COUNTS[s] - 1 behind it fit
            step = min(width, COUNTS[s] - width)
            run = run[:, : run.shape[1] - step] & run[:, step:]
            width += step
        np.copyto(best.reshape(blocks, BLOCK), s, where=run[:, :BLOCK])
    best = best[:n]
    take = np.array(COUNTS)[best]
    # All blocks step together from word to word.
    lane = np.arange(0, n, BLOCK)
    starts = []
    while len(lane):
        starts.append(lane)
        after = lane + take[lane]
        lane = after[after < end[lane]]
    starts = np.sort(np.concatenate(starts))
    sel = best[starts]
    width = np.where(sel == 0, 2, 1)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    stop = end[starts]
    for s in np.unique(sel):
        own = sel == s
        i, w = starts[own], place[own]
        if s == 0:
            words[w + 1] = v[i]
            continue
        packed = np.full(len(i), np.uint64(s) << np.uint64(60))
        if BITS[s]:
            for k in range(COUNTS[s]):
                live = i + k < stop[own]
                if not live.any():
                    break
                packed[live] |= v[i[live] + k] << np.uint64(k * BITS[s])
        words[w] = packed
    first = np.searchsorted(starts, np.arange(0, n, BLOCK))
    return words, place[first].astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of encode()."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    escape = np.flatnonzero(sel == 0)
    if len(escape):  # a raw value may look like an escape: walk those runs in order
        real, last = [], -2
        for e in escape.tolist():
            if e != last + 1:
                real.append(e)
                last = e
        raw = np.array(real) + 1
        # A raw value that starts a run of zero selectors must not swallow the word after it.
        head = np.ones(len(words), bool)
        head[raw] = False
    else:
        head = np.ones(len(words), bool)
    index = np.flatnonzero(head)
    s = sel[index]
    block = np.searchsorted(offsets, index, side="right") - 1
    count = np.array(COUNTS)[s]
    total = np.cumsum(count)
    # Values before each word in its block.
    first = np.searchsorted(index, offsets)
    before = total - count
    start = before - before[first][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    for k in np.unique(s):
        own = s == k
        if k == 0:
            out[start[own]] = words[index[own] + 1]
        elif BITS[k]:
            shift = (np.arange(COUNTS[k]) * BITS[k]).astype(np.uint64)
            mask = np.uint64((1 << BITS[k]) - 1)
            values = (words[index[own]][:, None] >> shift) & mask
            to = start[own][:, None] + np.arange(COUNTS[k])
            live = to < stop[own][:, None]
            out[to[live]] = values[live]
    return out

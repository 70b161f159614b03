"""Words of texts as hash arrays: runs of digits, a-z (A-Z lower-cased) and all characters from U+0080."""

from __future__ import annotations

import numpy as np

from readloom.llm.common import powers

# Byte table: A-Z to a-z, every byte that is in no word to a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
SCAN = 1 << 20  # bytes that are hashed at once


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * MIX
    return h ^ h >> np.uint64(29)


class Words:
    """The words of normalised texts: text number, start and end in the joined bytes, hash."""

    def __init__(self, texts: list[bytes | None]):
        raw = [(t or b"").translate(WORDS) for t in texts]
        edge = np.cumsum([0] + [len(r) + 1 for r in raw])
        self.data = b" ".join([*raw, b""])
        b = np.frombuffer(self.data, np.uint8)
        step = np.diff((b != 32).astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.text = np.searchsorted(edge, self.start, side="right") - 1
        self.offset = edge[:-1]
        self.first = np.searchsorted(self.start, edge)  # the first word of each text
        up, down = powers(min(len(b), SCAN))
        h, at = np.zeros(len(self.start), np.uint64), 0
        while at < len(h):
            # As many whole words as fit; a longer one is hashed alone.
            base = int(self.start[at])
            stop = max(at + 1, int(np.searchsorted(self.end, base + SCAN, side="right")))
            size = int(self.end[stop - 1]) - base
            if size > len(up):
                up, down = powers(size)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b[base : base + size] + np.uint64(1)) * up[:size], dtype=np.uint64)])
            s, e = self.start[at:stop] - base, self.end[at:stop] - base
            h[at:stop] = (sums[e] - sums[s]) * down[s]
            at = stop
        self.hash = mixed(h)

    def run(self, at: int, n: int) -> bytes:
        """The bytes of n words, joined by single spaces."""
        return b" ".join(self.data[s:e] for s, e in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist()))

    def hashed(self, at: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n words from each place."""
        out = np.zeros(len(at), np.uint64)
        for k in range(n):
            out = mixed(out ^ self.hash[at + k])
        return out

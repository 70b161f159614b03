"""Periodic runs of words, found while the words arrive, and texts with their repeats collapsed.

A run is a stretch of words with smallest period q (words q apart are equal) that no
neighbouring word extends. Runs of at least `min_length` words and `min_exponent`
periods are reported.

Squares are caught online. For each power of two B every completed block of B words
keeps a catcher: it watches for its own words to come again B * 2 - 1 to B * 4 - 2
words later, so that a square of any period holds a block whose catcher waits at just
that distance. Appended words extend the suffix hashes of all levels, and the suffix of
B words at each new word is compared with the two catchers of its level in reach. What
they catch is a stretch of words equal to those p before; while it reaches the end of
the text it is a live comparison that each further word advances or ends. A stretch of
p words or more is a family of squares, which merge into one run; of stretches with
equal borders the one of smallest period is the run, since all others have a multiple
of it. A live square also speaks for multiples of its period inside its borders, so
they are not compared again. Words may come one by one or in batches: the result
is the same, batches only compare many words in one numpy call.

Work per document is n log n; nothing is compared with all earlier words.

Defined results: a null, empty or blank text has no word and no run; repeated rows
give equal results each; a null id is kept, and is decimal text "" where the digest of
`report` asks for it; other columns are left out. Words are runs of anything but the
bytes 9 to 13 and 32.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import pieces, utf8
from readloom.llm.words import mixed

BATCH = 4096  # words appended at once
SEED = np.uint64(0xD6E8FEB86659FD93)


class Catchers:
    """Runs of a growing sequence of word numbers."""

    def __init__(self, min_length: int = 24, min_exponent: int = 3):
        self.min_length, self.min_exponent = min_length, max(2, min_exponent)
        self.n = 0
        self.words = np.zeros(64, np.int64)
        self.levels: list[np.ndarray] = []  # per level the hash of the block or suffix that starts at each word
        self.filled: list[int] = []
        self.live: dict[int, int] = {}  # period: where the stretch began that is equal to the words a period later, up to the end
        self.caught: dict[tuple[int, int], int] = {}  # (start, end): period

    def _needed(self, p):
        """The words of a stretch of period p from which it is reported."""
        return np.maximum(p * (self.min_exponent - 1), self.min_length - p)

    def append(self, words: np.ndarray) -> None:
        """The next words of the sequence."""
        old, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            grown = np.zeros(max(2 * len(self.words), self.n), np.int64)
            grown[:old] = self.words[:old]
            self.words = grown
        self.words[old : self.n] = words
        ended = self._advance(old)
        for p, begin, end in self._hits(old, ended):
            self._start(p, begin, end)

    def _advance(self, old: int) -> dict[int, int]:
        """Compare the new words with those that live stretches expect; where stretches ended, by period."""
        ended = {}
        for p in sorted(self.live):
            wrong = np.flatnonzero(self.words[old : self.n] != self.words[old - p : self.n - p])
            if len(wrong):
                ended[p] = old + int(wrong[0]) - p
                self._end(p, self.live.pop(p), ended[p])
        return ended

    def _hashes(self, level: int) -> tuple[int, np.ndarray]:
        """(how many were known, the hashes of this level) after hashing what the new words complete."""
        size = 1 << level
        if level == len(self.levels):
            self.levels.append(np.zeros(64, np.uint64))
            self.filled.append(0)
        known, count, held = self.filled[level], max(0, self.n - size + 1), self.levels[level]
        if count > len(held):
            grown = np.zeros(max(2 * len(held), count), np.uint64)
            grown[:known] = held[:known]
            self.levels[level] = held = grown
        if count > known:
            if level:
                half = self.levels[level - 1]
                held[known:count] = mixed(half[known:count] * SEED + half[known + size // 2 : count + size // 2])
            else:
                held[known:count] = mixed(self.words[known:count].astype(np.uint64) + SEED)
            self.filled[level] = count
        return known, held[:count]

    def _hits(self, old: int, ended: dict[int, int]):
        """Stretches that the catchers found: (period, first word, end), in order of period."""
        level = 0
        while 3 * (1 << level) - 1 <= self.n:
            size, near = 1 << level, 2 * (1 << level) - 1
            known, held = self._hashes(level)
            at = np.arange(max(known, near), len(held))  # where the new suffixes of this level begin
            found = []
            for back in (0, 1):
                block = ((at - near) // size - back) * size
                same = np.flatnonzero((block >= 0) & (held[at] == held[np.maximum(block, 0)]))
                found.append((at[same] - block[same], block[same]))
            level += 1
            p, block = (np.concatenate(x) for x in zip(*found))
            if not len(p):
                continue
            # What a live stretch has, or had until it ended, is known.
            busy = np.fromiter(self.live, np.int64, len(self.live))
            keep = ~np.isin(p, busy)
            for q, end in ended.items():
                keep &= (p != q) | (block + size > end)
            for q, start in self.live.items():
                if self.n - start >= 2 * q:  # a square speaks for the multiples of its period inside it
                    keep &= (p % q != 0) | (block < start)
            p, block = p[keep], block[keep]
            if not len(p):
                continue
            order = np.lexsort((block, p))
            p, block = p[order], block[order]
            head = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (block[1:] != block[:-1] + size)]))
            first, last, p = block[head], block[np.append(head[1:], len(p)) - 1], p[head]
            # A chain of blocks is short of a whole stretch by less than a block on either side.
            open_ = last + 2 * size + p > self.n
            keep = open_ | (last - first + 3 * size - 2 >= self._needed(p))
            for x in zip(p[keep].tolist(), first[keep].tolist(), (last[keep] + size).tolist()):
                if not self._spoken_for(*x):
                    yield x

    def _spoken_for(self, p: int, begin: int, end: int) -> bool:
        """Whether a square of a divisor of p spans this stretch and its later copy."""
        for q, start in self.live.items():
            if p % q == 0 and q < p and start <= begin and self.n - start >= 2 * q:
                return True
        return any(p % q == 0 and s <= begin and end + p <= e for (s, e), q in self._around(begin))

    def _around(self, at: int):
        return [(k, q) for k, q in self.caught.items() if k[0] <= at < k[1]]

    def _start(self, p: int, begin: int, end: int) -> None:
        """Extend what a catcher found to both sides, live if it reaches the end of the text."""
        w = self.words
        if not np.array_equal(w[begin:end], w[begin + p : end + p]):
            return  # equal hashes of unequal words
        while begin and w[begin - 1] == w[begin - 1 + p]:
            begin -= 1
        while end + p < self.n and w[end] == w[end + p]:
            end += 1
        if end + p == self.n:
            self.live[p] = min(begin, self.live.get(p, begin))
        else:
            self._end(p, begin, end)

    def _end(self, p: int, begin: int, end: int) -> None:
        """A stretch has ended: its squares are a run, unless one of a smaller period has its borders."""
        if end - begin >= self._needed(p):
            key = (begin, end + p)
            self.caught[key] = min(p, self.caught.get(key, p))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of all words so far, in order of start and period."""
        found = dict(self.caught)
        for p in sorted(self.live, reverse=True):
            if self.n - p - self.live[p] >= self._needed(p):
                key = (self.live[p], self.n)
                found[key] = min(p, found.get(key, p))
        return sorted((s, e - s, p) for (s, e), p in found.items())


def find_runs(words: np.ndarray, min_length: int = 24, min_exponent: int = 3, batch: int = BATCH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of word numbers."""
    catchers = Catchers(min_length, min_exponent)
    for at in range(0, len(words), batch):
        catchers.append(words[at : at + batch])
    return catchers.runs()


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) > 0


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; ties to the smallest start, then period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


SHOWN = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, text string"


def collapse(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3, rewrite=None) -> DataFrame:
    """Per row of docs: doc_id, n_runs, the run of greatest exponent, all runs, and the text without what runs repeat.

    `rewrite(n, id)` may give the order in which the n words of a text are read, as word
    numbers; None reads them as they come.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                ids, out = part.column("doc_id").to_pylist(), []
                for key, text in zip(ids, utf8(part.column("text"))):
                    words = (text or b"").split()
                    order = rewrite(len(words), key) if rewrite else None
                    if order is not None:
                        words = [words[k] for k in order.tolist()]
                    numbers: dict[bytes, int] = {}
                    seen = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                    found = find_runs(seen, min_length, min_exponent)
                    if found:
                        gone = dropped(len(words), found)
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    best = longest(found)
                    out.append((len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(words)))
                n, start, length, period, milli, every, kept = zip(*out) if out else ((),) * 7
                longs = [pa.array(x, pa.int64()) for x in (n, start, length, period, milli)]
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), *longs, pa.array(every, run_type), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "text"])

    return rows.mapInArrow(run, SHOWN)


def planted(n: int, key) -> np.ndarray | None:
    """The reading order of `report`: of about a tenth of the ids the words from a place on repeat with a period of up to a third."""
    import zlib

    h = zlib.crc32(b"" if key is None else str(key).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of all runs and collapsed texts, of texts read in the order of `planted`."""
    rows = collapse(docs, id_col=id_col, text_col=text_col, rewrite=planted)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return rows.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


# crc32 by its table; pairs of equal words by distance, their consecutive stretches, and of
# stretches with equal borders the smallest period: quadratic in the repeats of a word.
SQL = """
WITH RECURSIVE bits(b, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM bits WHERE k < 8),
step AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS digits FROM documents),
h AS (SELECT doc_id, r, w, len(w) AS n, xor(list_reduce(digits, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1]), 4294967295), 4294967295) AS h FROM d, step),
g AS (SELECT *, h % 10 = 0 AND n > 0 AS again, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM h),
x AS (SELECT r, n, w, unnest(range(n)) AS i, again, a, 1 + (n - a) // (3 + g % 8) AS p FROM g),
u AS (SELECT r, n, i, w[CASE WHEN again AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word FROM x),
pairs AS (SELECT a.r, b.i - a.i AS p, a.i FROM u a JOIN u b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND (b.i - a.i) * 3 <= a.n),
stretch AS (SELECT r, p, min(i) AS s, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM pairs) GROUP BY r, p, island),
runs AS (SELECT r, s, m + p AS length, min(p) AS period FROM (SELECT r, s, m, p, s + m + p AS e FROM stretch WHERE m >= 2 * p AND m + p >= 24) GROUP BY r, s, m + p),
told AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || length || ',' || period || chr(10), '' ORDER BY s, period) AS lines FROM runs GROUP BY r),
best AS (SELECT r, s, length, period FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, s, period) AS k FROM runs) WHERE k = 1),
gone AS (SELECT DISTINCT r, unnest(range(s + period, s + length)) AS i FROM runs),
kept AS (SELECT u.r, string_agg(word, ' ' ORDER BY u.i) AS text FROM u ANTI JOIN gone ON u.r = gone.r AND u.i = gone.i GROUP BY u.r)
SELECT g.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM g LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

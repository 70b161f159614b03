"""Removal of long repeated byte strings, by a depth-limited radix sort of suffixes.

Every suffix that is at least `length` bytes long takes part with its first
`length` bytes, its window. Windows are dealt by a first digit that equal windows
share: the lowest-hashed `gram`-byte string inside, at its place in the window (the
anchor). Neighbouring windows with one anchor travel together as a stretch of text;
equal stretches are counted as one, so copies of any number cost one entry. In a
group of stretches that share an anchor string, most-significant-digit passes walk
away from the anchor, to the right and to the left, and split the group by one more
byte each; no pass goes beyond a window. Suffixes that are still together when both
passes have covered a window are exactly the repeated windows.

Skew: a group of more than `most` distinct stretches is split by longer digits: the
windows of a stretch are halved by their distance from the anchor, and each half is
dealt anew by all the bytes that its windows share, down to single windows, which
only need counting. So no task holds an unbounded group.

Hashes that decide equality have 128 bits.

Defined results: a null or empty text has 0 bytes and nothing removed; a text
shorter than a window stays whole; rows that repeat id and text are copies of each
other; a null id is an id like any other; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import pieces, powers, same, stash

CHUNK = 1 << 18  # window starts that are hashed at once; below 1 << 20


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the lowest of each w neighbouring hashes, by 44 of their bits; the leftmost of equal ones. There are fewer than 1 << 20."""
    key = (h & np.uint64(~((1 << 20) - 1) & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
    n = len(h) - w + 1
    full = np.full(-(-len(h) // w) * w, np.uint64((1 << 64) - 1))
    full[: len(h)] = key
    grid = full.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64((1 << 20) - 1)).astype(np.int64)


class Anchors:
    """Finds the stretches of neighbouring windows with one anchor."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        self.up, self.down = powers(CHUNK + length)

    def stretches(self, text: bytes):
        """(first window start, last, anchor, anchor hash) arrays of a text."""
        found = []
        for at in range(0, max(0, len(text) - self.length + 1), CHUNK):
            part = text[at : at + CHUNK + self.length - 1]
            found.append([x if k == 3 else x + at for k, x in enumerate(self._chunk(np.frombuffer(part, np.uint8)))])
        return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]

    def _chunk(self, b: np.ndarray):
        g, w = self.gram, self.span
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * self.up[: len(b)], dtype=np.uint64)])
        h = (sums[g:] - sums[:-g]) * self.down[: len(b) - g + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        place, n = window_minima(h, w), len(h) - w + 1
        first = np.concatenate([[0], 1 + np.flatnonzero(place[1:] != place[:-1])])
        last = np.concatenate([first[1:] - 1, [n - 1]])
        return first, last, place[first], h[place[first]]


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _stretch_table(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, version, first, last, anchor, gram, lo, hi): every stretch of every text."""

    def run(batches):
        find = Anchors(length, gram)
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                row, tables, digests = [], [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    first, last, anchor, value = find.stretches(text or b"")
                    tables.append((first, last, anchor, value))
                    row.append(len(first))
                    digests += [
                        xxhash.xxh3_128_digest(text[i : j + length], p - i) for i, j, p in zip(first.tolist(), last.tolist(), anchor.tolist())
                    ]
                index = pa.array(np.repeat(np.arange(len(row)), row))
                first, last, anchor, value = (np.concatenate(x) for x in zip(*tables))
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").take(index),
                        "version": part.column("version").take(index),
                        "first": pa.array(first, pa.int64()),
                        "last": pa.array(last, pa.int64()),
                        "anchor": pa.array(anchor, pa.int64()),
                        "gram": pa.array(value.view(np.int64), pa.int64()),
                        "lo": pa.array(both[:, 0], pa.int64()),
                        "hi": pa.array(both[:, 1], pa.int64()),
                    }
                )

    return rows.mapInArrow(run, "doc_id long, version long, first long, last long, anchor long, gram long, lo long, hi long")


GROUP = "k1 long, k2 long, x int, w int"
ENTRY = "doc_id long, version long, start long, near int, far int, single boolean, text binary"


def _cut(rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The text of each stretch in rows, which name the documents they lie in.

    A row's windows start near to far bytes before its anchor; start is the place of its text.
    """
    by_doc = rows.groupBy("doc_id", "version").agg(F.collect_list(F.struct("gram", "first", "last", "anchor", "single", "length")).alias("cuts"))
    joined = by_doc.alias("c").join(docs.alias("d"), same("c", "d", "doc_id", "version")).select("d.doc_id", "d.version", "d.text", "c.cuts")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                out = []
                for doc, version, text, cuts in zip(*(part.column(c).to_pylist() for c in ("doc_id", "version", "text", "cuts"))):
                    for c in cuts:
                        out.append((c["gram"], 0, 0, width, doc, version, c["first"], c["anchor"] - c["last"], c["anchor"] - c["first"], c["single"], text[c["first"] : c["last"] + c["length"]]))
                    if len(out) > 2000:
                        yield _entries(out)
                        out = []
                yield _entries(out)

    return joined.mapInArrow(run, f"{GROUP}, {ENTRY}")


def _entries(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in f"{GROUP}, {ENTRY}".split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _split(entries: DataFrame, length: int) -> DataFrame:
    """Each entry in two: the windows of the nearer and the farther half of its distances, dealt by what those share."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                out = []
                for r in part.to_pylist():
                    half = r["w"] // 2
                    for x in (r["x"], r["x"] + half):
                        near, far = max(r["near"], x), min(r["far"], x + half - 1)
                        if near > far:
                            continue
                        # The text starts at distance r["far"]; its windows at x .. x + half - 1 share these bytes.
                        zero = r["far"]
                        k1, k2 = _halves(xxhash.xxh3_128_digest(r["text"][zero - x : zero - x - half + 1 + length], x << 10 | half))
                        text = r["text"][zero - far : zero - near + length] if half > 1 else b""
                        out.append((k1, k2, x, half, r["doc_id"], r["version"], r["start"] + zero - far, near, far, r["single"], text))
                yield _entries(out)

    return entries.mapInArrow(run, f"{GROUP}, {ENTRY}")


def repeated(group: np.ndarray, near: np.ndarray, far: np.ndarray, texts: list[bytes], length: int, reach: int) -> np.ndarray:
    """Per entry and distance: whether another entry of its group has that window, by radix passes from the anchor."""
    m = len(texts)
    grid = np.full((reach + length, m), 256, np.int64)
    for k, (t, d) in enumerate(zip(texts, far.tolist())):
        grid[reach - d : reach - d + len(t), k] = np.frombuffer(t, np.uint8)
    start = np.unique(group, return_inverse=True)[1].astype(np.int64)
    right = start
    ends = {}
    for depth in range(length):
        right = np.unique(right * 257 + grid[reach + depth], return_inverse=True)[1]
        ends[depth + 1] = right
    dup = np.zeros((m, reach + 1), bool)
    left = start
    for d in range(reach + 1):
        if d:
            left = np.unique(left * 257 + grid[reach - d], return_inverse=True)[1]
        live = np.flatnonzero((near <= d) & (d <= far))
        if len(live) > 1:
            _, which, count = np.unique(left[live] * (m + 1) + ends[length - d][live], return_inverse=True, return_counts=True)
            dup[live, d] = count[which] > 1
    return dup


def _spans(entries: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, version, begin, end): what the repeated windows of single stretches cover, group by group."""
    reach = length - gram

    def work(rows):
        single = np.array(rows["single"])
        group = np.unique(np.array([rows["k1"], rows["k2"], rows["x"], rows["w"]]), axis=1, return_inverse=True)[1].ravel()
        near, far = np.array(rows["near"]), np.array(rows["far"])
        dup = repeated(group, near, far, rows["text"], length, reach) & single[:, None]
        k, d = np.nonzero(dup[:, ::-1])  # by entry, in order of the window's place
        place = np.array(rows["start"])[k] + far[k] - (reach - d)
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (place[1:] > place[:-1] + length)
        begin = np.flatnonzero(new)
        stop = np.concatenate([begin[1:] - 1, [len(k) - 1]]) if len(k) else begin
        doc, version = pa.array(rows["doc_id"], pa.int64()), pa.array(rows["version"], pa.int64())
        index = pa.array(k[begin])
        return pa.record_batch({"doc_id": doc.take(index), "version": version.take(index), "begin": pa.array(place[begin], pa.int64()), "end": pa.array(place[stop] + length, pa.int64())})

    def run(batches):
        names = [x.split()[0] for x in f"{GROUP}, {ENTRY}".split(", ")]
        held = {c: [] for c in names}
        last, cut = None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            for row in zip(*columns):
                if row[:4] != last:
                    cut = len(held["k1"])  # whole groups so far
                    if cut >= 4096:
                        yield work(held)
                        held, cut = {c: [] for c in names}, 0
                    last = row[:4]
                for c, v in zip(names, row):
                    held[c].append(v)
        if held["k1"]:
            yield work(held)

    keys = ["k1", "k2", "x", "w"]
    return entries.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "doc_id long, version long, begin long, end long")


def repeated_spans(docs: DataFrame, *, length: int = 400, gram: int = 64, most: int = 4096) -> DataFrame:
    """(doc_id, version, begin, end) byte ranges that repeated windows cover; they may overlap. docs: doc_id, version, text as bytes."""
    stretches = stash(_stretch_table(docs, length, gram), "stretches")
    distinct = stash(stretches.groupBy("gram", "lo", "hi").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "first", "last", "anchor")).alias("at")), "distinct")
    copies = stretches.join(distinct.where("n > 1").select("gram", "lo", "hi"), ["gram", "lo", "hi"], "left_semi")
    found = [copies.select("doc_id", "version", F.col("first").alias("begin"), (F.col("last") + length).alias("end"))]
    groups = distinct.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    contested = distinct.join(groups, "gram", "left_semi").select("gram", "at.*", (F.col("n") == 1).alias("single"), F.lit(length).alias("length"))
    width = 1 << (length - gram).bit_length()  # distances from the anchor, rounded up
    entries = stash(_cut(contested, docs, width), "entries")
    keys = ["k1", "k2", "x", "w"]
    while True:
        if width == 1:  # a group is one window: only count
            same_window = entries.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").select(*keys)
            hit = entries.where("single").join(same_window, keys, "left_semi")
            found.append(hit.select("doc_id", "version", F.col("start").alias("begin"), (F.col("start") + length).alias("end")))
            break
        large = entries.groupBy(*keys).agg(F.count("*").alias("k")).where(F.col("k") > most).select(*keys)
        if large.isEmpty():
            found.append(_spans(entries, length, gram))
            break
        large = stash(large, "large")
        found.append(_spans(entries.join(large, keys, "left_anti"), length, gram))
        halves = _split(entries.join(large, keys, "left_semi"), length)
        width //= 2
        entries = stash(halves, "entries")
        alone = entries.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").select(*keys)
        entries = entries.join(alone, keys, "left_semi")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def kept(text: bytes | None, ranges: list) -> tuple[bytes, list]:
    """(what stays of a text, maximal removed ranges)."""
    text, merged = text or b"", []
    for begin, end in sorted(ranges or []):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([begin, end])
    parts, at = [], 0
    for begin, end in merged:
        parts.append(text[at:begin])
        at = end
    return b"".join([*parts, text[at:]]), merged


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64, most: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (array of begin, end), kept (bytes that stay)."""
    if not 0 < gram <= length <= 1000:
        raise ValueError("gram must be in 1..length and length at most 1000")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("version", F.xxhash64("text"))
    spans = repeated_spans(rows, length=length, gram=gram, most=most)
    by_doc = spans.groupBy("doc_id", "version").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    joined = rows.alias("d").join(by_doc.alias("s"), same("d", "s", "doc_id", "version"), "left").select("d.doc_id", "d.text", "s.ranges")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text").to_pylist()
                done = [kept(t, r and [(x["begin"], x["end"]) for x in r]) for t, r in zip(texts, part.column("ranges").to_pylist())]
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_bytes": pa.array([len(t or b"") for t in texts], pa.int64()),
                        "spans": pa.array([[{"begin": b, "end": e} for b, e in s] for _, s in done], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                        "kept": pa.array([t for t, _ in done], pa.binary()),
                    }
                )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def digest(docs: DataFrame, **options) -> DataFrame:
    """What remove_repeats() does to each row."""
    done = remove_repeats(docs, **options)
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )

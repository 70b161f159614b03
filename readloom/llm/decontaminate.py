"""Benchmark decontamination by normalised word windows.

A-Z are lower-cased; words are runs of digits, a-z and all characters from U+0080.
A window is `window` consecutive words of an item, or all of an item that has fewer
(but some). Documents are scanned with a hash set of windows: word hashes of many
documents are taken at once, runs of words that the benchmark has are hashed and
looked up, and each hit is verified byte for byte.

The set holds an item's text and about SET_BYTES a word as flat arrays. It is broadcast
only if that is at most `most_bytes`, which is summed first. A larger benchmark is
dealt into parts of that size, an item that is larger itself into overlapping runs of
its words. One part after the other is broadcast and scans the documents as they came;
what the parts found is written and merged per document before anything is cut.

Defined results: a null or wordless text has no words and no hits; a null or
wordless item has no window; equal items all count; a null item_id counts in
n_items and is the string "null"; rows that repeat a doc_id each get a row; other
columns are left out of the report and kept by the filters, under any names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import fresh, pieces, same, stash, utf8
from readloom.llm.words import SCAN, Words

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same for Spark, before lower-casing
SET_BYTES = 48


class Windows:
    """The window set of some items, by window length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.items, number = np.unique(np.array([i for i, _ in items], object).astype(str), return_inverse=True) if items else (np.zeros(0, str), np.zeros(0, int))
        self.words = Words([t for _, t in items])
        size = np.diff(self.words.first)
        self.known = np.zeros(1 << 20, bool)
        self.known[self.words.hash >> np.uint64(44)] = True
        self.tables = []
        for n in np.unique(np.minimum(size, window)).tolist():
            if not n:
                continue
            of = np.flatnonzero(np.minimum(size, window) == n)
            count = size[of] - n + 1
            at = np.repeat(self.words.first[of] - np.cumsum(count) + count, count) + np.arange(count.sum())
            value = self.words.hashed(at, n)
            order = np.lexsort((number[self.words.text[at]], value))
            at, value = at[order], value[order]
            # A window that several items, or places, have is one entry with the owners that follow it.
            head = np.concatenate([[True], value[1:] != value[:-1]])
            for k in np.flatnonzero(~head).tolist():
                head[k] = self.words.run(at[k], n) != self.words.run(at[k - 1], n)
            first = np.flatnonzero(head)
            self.tables.append((n, value[first], at[first], np.append(first, len(at)), number[self.words.text[at]].astype(np.int32)))
        self.words.hash = self.words.text = None  # only the bytes are read from now on

    def scan_all(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, list[str]]]:
        """Per text: (number of words, hit word positions, sorted items with an occurring window)."""
        own = Words(texts)
        bounds = own.first
        hit = np.zeros(len(own.hash) + 1, np.int64)
        items: dict[int, set[int]] = {}
        unknown = np.concatenate([[0], np.cumsum(~self.known[own.hash >> np.uint64(44)])])
        for n, values, at, owner, owners in self.tables:
            if len(own.hash) < n:
                continue
            # Only runs of known words of one text can hit.
            place = np.flatnonzero((unknown[n:] == unknown[:-n]) & (own.text[n - 1 :] == own.text[: len(own.text) - n + 1]))
            value = own.hashed(place, n)
            low, high = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
            for i in np.flatnonzero(high > low).tolist():
                text = own.run(place[i], n)
                for k in range(low[i], high[i]):
                    if self.words.run(at[k], n) == text:
                        hit[place[i]] += 1
                        hit[place[i] + n] -= 1
                        items.setdefault(int(own.text[place[i]]), set()).update(owners[owner[k] : owner[k + 1]].tolist())
        covered = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
        parts = np.split(covered, np.searchsorted(covered, bounds[1:-1]))
        return [(b - a, part - a, sorted(self.items[list(items[k])].tolist()) if k in items else []) for k, (a, b, part) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), parts))]

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray, list[str]]:
        return self.scan_all([text])[0]


def _parts(benchmark: DataFrame, item_col: str, text_col: str, window: int, most_bytes: int) -> list[DataFrame]:
    """The items (item, text) in parts whose sets take at most most_bytes each."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    words = F.regexp_count("text", F.lit(WORD))
    run = max(2 * window, most_bytes // (8 * SET_BYTES))  # words of a longer item that go together
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(0), F.size(found) - window, F.lit(run - window + 1))
    cut = F.when(words > run, F.transform(starts, lambda s: F.array_join(F.slice(found, s + 1, F.lit(run)), " "))).otherwise(F.array("text"))
    rows = stash(rows.select("item", F.explode(cut).alias("text")).withColumn("size", F.octet_length("text") + SET_BYTES * words), "benchmark")
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = -(-total // most_bytes)
    while n > 1:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        largest = dealt.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where("n > 1").agg(F.max("size")).first()[0]
        if (largest or 0) <= most_bytes:
            return [dealt.where(F.col("part") == k).select("item", "text") for k in range(n)]
        n += -(-n // 2)
    return [rows.select("item", "text")]


def _shared(part: DataFrame, window: int):
    """A part's window set as a broadcast; _parts() has bounded it."""
    return part.sparkSession.sparkContext.broadcast(Windows([(r.item, r.text.encode()) for r in part.collect()], window))


def hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, most_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, hit (array of word positions), items (sorted array of strings)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = _parts(benchmark, item_col, item_text, window, most_bytes)

    def scan(rows: DataFrame, shared) -> DataFrame:
        def run(batches):
            windows = shared.value
            for batch in batches:
                for part in pieces(batch, "text", SCAN):
                    found = windows.scan_all(utf8(part.column("text")))
                    yield pa.record_batch(
                        {
                            **{c: part.column(c) for c in part.schema.names if c != "text"},
                            "n_words": pa.array([f[0] for f in found], pa.int64()),
                            "hit": pa.array([f[1] for f in found], pa.list_(pa.int32())),
                            "items": pa.array([f[2] for f in found], pa.list_(pa.string())),
                        }
                    )

        keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
        return rows.mapInArrow(run, ", ".join([*keys, "n_words long", "hit array<int>", "items array<string>"]))

    if len(parts) == 1:
        return scan(rows, _shared(parts[0], window))
    keyed = rows.withColumn("version", F.xxhash64("text"))
    each = []
    for part in parts:
        shared = _shared(part, window)
        each.append(stash(scan(keyed, shared), "hits"))
        shared.destroy()
    found = functools.reduce(DataFrame.unionByName, each).groupBy("doc_id", "version").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count("*").alias("n"),
    )
    again = F.explode(F.sequence(F.lit(1), (F.col("n") / len(parts)).cast("int")))
    return found.select("doc_id", "n_words", "hit", "items", again.alias("row")).drop("row")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The per-document digest of hits()."""
    found = hits(docs, benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 10, item_col: str = "item_id", item_text: str = "text", most_bytes: int = 64 << 20) -> DataFrame:
    """docs without the rows in which a window of an item occurs; all columns kept, no shuffle."""
    parts = _parts(benchmark, item_col, item_text, window, most_bytes)
    out = docs
    for k, items in enumerate(parts):
        shared = _shared(items, window)

        def clean(batches, shared=shared):
            for batch in batches:
                for part in pieces(batch, text_col, SCAN):
                    found = shared.value.scan_all(utf8(part.column(text_col)))
                    yield part.filter(pa.array([not len(f[1]) for f in found], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
        if k + 1 < len(parts):
            out = stash(out, "clean")
            shared.destroy()
    return out


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 10, item_col: str = "item_id", item_text: str = "text", most_bytes: int = 64 << 20) -> DataFrame:
    """docs with every hit word cut out of the text, together with what stands between neighbouring hit words."""
    schema = docs.schema
    parts = _parts(benchmark, item_col, item_text, window, most_bytes)

    def replaced(part, texts):
        at = part.schema.get_field_index(text_col)
        names = [f.name for f in schema]
        return pa.record_batch([pa.array(texts, pa.string()) if k == at else part.column(c) for k, c in enumerate(names)], names=names)

    if len(parts) == 1:
        shared = _shared(parts[0], window)

        def run(batches):
            for batch in batches:
                for part in pieces(batch, text_col, SCAN):
                    raw = utf8(part.column(text_col))
                    yield replaced(part, [cut(t, f[1]) for t, f in zip(raw, shared.value.scan_all(raw))])

        return docs.mapInArrow(run, schema)
    named = fresh(docs.columns, "hit")
    # All parts look at the texts as they came; a text is cut once, by what all have found.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.xxhash64(F.col(text_col)).alias("doc_id"), F.col(text_col).alias("text"))
    found = hits(rows.select("doc_id", "text"), benchmark, item_col=item_col, item_text=item_text, window=window, most_bytes=most_bytes)
    found = found.where(F.size("hit") > 0).select("doc_id", "hit").distinct()
    joined = rows.alias("a").join(found.alias("b"), same("a", "b", "doc_id"), "left").select("row.*", F.col("hit").alias(named))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text_col, SCAN):
                yield replaced(part, [cut(t, np.array(h or [], np.int64)) for t, h in zip(utf8(part.column(text_col)), part.column(named).to_pylist())])

    return joined.mapInArrow(run, schema)


def cut(raw: bytes | None, hit: np.ndarray) -> str | None:
    """A text without its hit words, and without what stands between neighbouring ones."""
    if raw is None or not len(hit):
        return raw if raw is None else raw.decode()
    words = Words([raw])
    breaks = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.concatenate([[0], breaks + 1])], hit[np.concatenate([breaks, [len(hit) - 1]])]
    keep, at = [], 0
    for a, b in zip(words.start[first].tolist(), words.end[last].tolist()):
        keep.append(raw[at:a])
        at = b
    keep.append(raw[at:])
    return b"".join(keep).decode()


def cut_spans(text: str | None, windows: Windows) -> str | None:
    return cut(text and text.encode(), windows.scan(text and text.encode())[1]) if text else text


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iz AS (SELECT *, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM iz)),
dz AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM iz) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS k FROM dz) d JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words h ON h.doc_id = d.doc_id LEFT JOIN items m ON m.doc_id = d.doc_id
"""

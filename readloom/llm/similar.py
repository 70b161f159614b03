"""Near-copies beyond the reach of one fingerprint: five-word similarity of 0.8 or more.

Documents that share 0.8 of their five-word shingles differ in 5 to 14 bits of a
64-bit SimHash, too many to look up. So the SimHash groups of radius 3 are joined
with candidates found from samples of the shingles: 2 * BANDS hash orders give the
lowest shingle of each, and documents that agree in both places of any of the BANDS
pairs are candidates, as are those of one SimHash group. Documents with the same set
of shingles, by a 128-bit digest of it, are one: only the smallest id goes on. Each
group first names one hub, its smallest id: a member that agrees with it in enough of
PLACES more places is decided on the shingle sets, which joins most of a group at the
cost of one pair per member. Groups whose members are not all joined then are dealt to
cells: a group of many members, or of much text, is cut into chunks, and each two chunks
meet in a cell of their own. A cell first looks at places only and names the members
that have a partner left: one that no chain of links joins with it yet and that agrees
in enough places. Only these meet in the cell again with their texts, one copy of each,
and there the pairs are decided on the hashes of their shingles, the likeliest first; a
link saves all pairs between what it joins. A pair belongs to the group of the first band in which
both agree, so no two groups decide it. No pair travels: a family of near-copies that
just miss the bound costs comparisons in its cells, in the square of its size, but no
rows. So a pair stays apart only if its texts say so, whichever ids its group holds; two
samples hide a pair of similarity 0.8 with a probability of 8e-8 (no band in common)
and below 1e-9 (too few places).

Defined results: texts without words do not link here; rows with a null id do not
link and stay; rows that repeat an id are one document; other columns are kept.
"""

from __future__ import annotations

import hashlib
import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import pieces, stash, unstash, utf8
from readloom.llm.graph import components
from readloom.llm.simhash import keep_one, near_duplicates

PLACES, BANDS = 256, 16
SENT = 1 << 20  # ids that are broadcast at most, about 30 MB


def _orders() -> tuple[np.ndarray, ...]:
    """Flips and odd factors of the hash orders: of 64 bits for the bands, of 32 bits for the places."""
    rng = np.random.default_rng(5)
    wide = [rng.integers(0, 1 << 63, 2 * BANDS, dtype=np.uint64) for _ in "ab"]
    narrow = [rng.integers(0, 1 << 32, PLACES, dtype=np.uint32) for _ in "ab"]
    return wide[0], wide[1] | np.uint64(1), narrow[0], narrow[1] | np.uint32(1)


def fewest(similarity: float, miss: float = 1e-9) -> int:
    """The largest number of places of which a pair of that similarity agrees in fewer with a probability below `miss`."""
    below, k = 0.0, 0
    while k < PLACES and (below := below + math.comb(PLACES, k) * similarity**k * (1 - similarity) ** (PLACES - k)) < miss:
        k += 1
    return k


def lowest(text: bytes | None, shingle: int, seed: int, orders) -> tuple[np.ndarray, np.ndarray, bytes] | None:
    """The lowest shingle hash in each order, of the bands and of the places, and a digest of the set of shingles; None for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return None
    runs = sorted(set(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64)
    short = (hashes ^ hashes >> np.uint64(32)).astype(np.uint32)
    flip, times, flip_, times_ = orders
    best, best_ = np.full(2 * BANDS, np.uint64((1 << 64) - 1)), np.full(PLACES, np.uint32((1 << 32) - 1))
    for at in range(0, len(hashes), 1024):
        np.minimum(best, ((hashes[at : at + 1024, None] ^ flip) * times).min(0), out=best)
        np.minimum(best_, ((short[at : at + 1024, None] ^ flip_) * times_).min(0), out=best_)
    return best, best_, hashlib.blake2b(b"\n".join(runs), digest_size=16).digest()


def shingles(text: bytes, n: int) -> frozenset:
    words = text.lower().split()
    return frozenset(map(b" ".join, zip(*(words[i:] for i in range(n))))) if len(words) >= n else frozenset([b" ".join(words)])


def signatures(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """(doc_id, bands, low, all, size) of each text with words: low has the lowest byte of each place, all is a digest of the set of shingles, size counts bytes."""

    def run(batches):
        orders = _orders()
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                texts = utf8(part.column("text"))
                found = [lowest(t, shingle, seed, orders) for t in texts]
                index = [k for k, f in enumerate(found) if f is not None]
                wide = np.array([found[k][0] for k in index], np.uint64).reshape(-1, 2 * BANDS)
                pair = wide[:, ::2] * np.uint64(0x9E3779B97F4A7C15) ^ wide[:, 1::2]
                pair = pair * np.uint64(2 * BANDS + 1) + np.arange(BANDS, dtype=np.uint64)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(pair.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
                low = [(found[k][1] & np.uint32(255)).astype(np.uint8).tobytes() for k in index]
                yield pa.record_batch({"doc_id": part.column("doc_id").take(pa.array(index, pa.int64())), "bands": bands, "low": pa.array(low, pa.binary()), "all": pa.array([found[k][2] for k in index], pa.binary()), "size": pa.array([len(texts[k]) for k in index], pa.int64())})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    return picked.mapInArrow(run, "doc_id long, bands array<long>, low binary, all binary, size long")


def agreeing(least: int):
    """The rows (u, v, x, y) whose places x and y agree in at least `least` bytes, as (u, v)."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PLACES) for c in "xy")
            near = pa.array((x == y).sum(1) >= least)
            yield pa.record_batch({c: batch.column(c).filter(near) for c in "uv"})

    return run


def _texts(docs: DataFrame, asked: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of the asked ids, once each, written."""
    ids = stash(asked.select("doc_id").distinct(), "asked")
    # So few ids go to the texts; more of them meet in a shuffle.
    listed = F.broadcast(ids) if ids.count() <= SENT else ids
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(listed, "doc_id", "left_semi")
    texts = stash(texts.groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    unstash(ids)
    return texts


def decided(docs: DataFrame, pairs: DataFrame, *, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets are at least so similar, written."""
    texts = _texts(docs, pairs.select(F.explode(F.array("u", "v")).alias("doc_id")), id_col=id_col, text_col=text_col)
    both = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")

    def decide(batches):
        hub, theirs = None, frozenset()
        for batch in batches:
            for part in pieces(batch, "a", 4 << 20):
                us, vs, keep = part.column("u").to_pylist(), part.column("v").to_pylist(), []
                for v, a, b in zip(vs, utf8(part.column("a")), utf8(part.column("b"))):
                    if v != hub:
                        hub, theirs = v, shingles(b, shingle)
                    mine = shingles(a, shingle)
                    common = len(mine & theirs)
                    keep.append(common >= similarity * (len(mine) + len(theirs) - common))
                yield pa.record_batch({"u": pa.array([u for u, k in zip(us, keep) if k], pa.int64()), "v": pa.array([v for v, k in zip(vs, keep) if k], pa.int64())})

    out = stash(both.select("u", "v", "a", "b").mapInArrow(decide, "u long, v long"), "links")
    unstash(texts)
    return out


CELL = ("kind", "key", "one", "two")
MEMBER = ("doc_id", "label", "chunk", "hub")
SCHEMA = ", ".join(f"{c} long" for c in (*CELL, *MEMBER))


class Cell:
    """The members of a group, or of two chunks of it, that meet in a task."""

    def __init__(self, numbers: np.ndarray, low: np.ndarray, bands: np.ndarray):
        """numbers: the columns of CELL and MEMBER; low: the places of each member; bands: its band keys."""
        self.kind, self.key, one, two = numbers[:4, 0].tolist()
        self.ids, self.labels, self.chunks, hubs = numbers[4:]
        self.hub, self.one_chunk = int(hubs[0]), one == two
        self.low, self.bands = low, bands

    def left(self, least: int):
        """Slices (i, j, places) of the pairs that are this cell's to decide, each once: members without a link between
        them that agree in `least` places and in no band before this group's. The hub has been decided."""
        _, label, size = np.unique(self.labels, return_inverse=True, return_counts=True)
        asks = label != np.argmax(size)  # members of the largest label are partners only
        place = np.arange(len(label))
        for at in range(0, int(asks.sum()), 32):
            mine = np.flatnonzero(asks)[at : at + 32]
            agree = (self.low[mine, None] == self.low[None, :]).sum(2, dtype=np.uint16)
            ok = (agree >= least) & (label[mine, None] != label) & (~asks | (place > mine[:, None])) & (self.ids != self.hub) & (self.ids[mine, None] != self.hub)
            if not self.one_chunk:
                ok &= self.chunks[mine, None] != self.chunks
            i, j = np.nonzero(ok)
            common = self.bands[mine[i]] == self.bands[j]
            own = common.argmax(1) == (self.bands[mine[i]] == self.key).argmax(1) if self.kind == 0 else ~common.any(1)
            yield mine[i][own], j[own], agree[i, j][own]

    def open(self, least: int) -> np.ndarray:
        """Which members have a partner left."""
        out = np.zeros(len(self.ids), bool)
        for i, j, _ in self.left(least):
            out[i] = out[j] = True
        return out

    def links(self, sets: list[np.ndarray], least: int, similarity: float) -> tuple[list[tuple[int, int]], int]:
        """(links between members that join what was apart, number of pairs decided); sets are the members' shingle hashes."""
        found = list(self.left(least))
        i, j, agree = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, int)] * 3
        names, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        of = np.split(flat, np.cumsum([len(x) for x in sets])[:-1]) if sets else []
        up, out, n, mark = {}, [], 0, np.zeros(len(names), bool)

        def root(x):
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        order = np.argsort(-agree.astype(np.int32), kind="stable")
        for a, b in zip(i[order].tolist(), j[order].tolist()):
            ra, rb = root(int(self.labels[a])), root(int(self.labels[b]))
            if ra == rb:
                continue
            n += 1
            mark[of[a]] = True
            common = int(mark[of[b]].sum())
            mark[of[a]] = False
            if common >= similarity * (len(of[a]) + len(of[b]) - common):
                up[max(ra, rb)] = min(ra, rb)
                out.append((int(max(self.ids[a], self.ids[b])), int(min(self.ids[a], self.ids[b]))))
        return out, n


def _by_cell(done):
    """done(numbers, low, bands, texts) of each cell of a partition that is sorted by CELL."""

    def run(batches):
        rest = None
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy() for c in (*CELL, *MEMBER)])
            low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(-1, PLACES)
            bands = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
            texts = utf8(batch.column("text")) if "text" in batch.schema.names else [None] * len(low)
            if rest is not None:
                now, low, bands, texts = np.concatenate([rest[0], now], axis=1), np.concatenate([rest[1], low]), np.concatenate([rest[2], bands]), rest[3] + texts
            cut = [0, *(1 + np.flatnonzero((now[:4, 1:] != now[:4, :-1]).any(0)))]
            for at, end in zip(cut, cut[1:]):
                yield from done(now[:, at:end], low[at:end], bands[at:end], texts[at:end])
            rest = now[:, cut[-1] :], low[cut[-1] :], bands[cut[-1] :], texts[cut[-1] :]
        if rest is not None and len(rest[1]):
            yield from done(*rest)

    return run


def cells(grouped: DataFrame, own: DataFrame, labels: DataFrame, *, most: int = 1024, most_bytes: int = 16 << 20) -> DataFrame:
    """The columns of CELL and MEMBER for each member and cell, of the groups that links do not join yet.

    A chunk has about `most` members and `most_bytes` of text, and a cell two chunks. In a group of
    two the other is the hub, so nothing is left.
    """
    rows = grouped.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("kind", "key", "doc_id", "hub", F.coalesce("component", "doc_id").alias("label"))
    rows = rows.join(own.select("doc_id", "size"), "doc_id")
    mixed = rows.groupBy("kind", "key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("a <> b AND n > 2")
    parts = F.ceil(F.greatest(F.col("n") / most, F.col("bytes") / most_bytes))
    rows = rows.join(mixed.select("kind", "key", parts.alias("parts")), ["kind", "key"])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "parts"))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda c: F.struct(F.least("chunk", c).alias("one"), F.greatest("chunk", c).alias("two")))
    return rows.withColumn("c", F.explode(meet)).select("kind", "key", "c.one", "c.two", *MEMBER)


def links_in_cells(docs: DataFrame, met: DataFrame, own: DataFrame, *, id_col: str, text_col: str, shingle: int, seed: int, least: int, similarity: float) -> DataFrame:
    """(u, v), u > v, of similar documents that labels did not join, enough to join them; met is of cells()."""

    def open_members(numbers, low, bands, _):
        at = np.flatnonzero(Cell(numbers, low, bands).open(least))
        if len(at):
            yield pa.record_batch([pa.array(x[at]) for x in numbers], names=[*CELL, *MEMBER])

    def decide(numbers, low, bands, texts):
        sets = [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(t, shingle), repeat(seed)), np.uint64)) for t in texts]
        found, _ = Cell(numbers, low, bands).links(sets, least, similarity)
        if found:
            u, v = zip(*found)
            yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def dealt(rows):
        return rows.repartition(*CELL).sortWithinPartitions(*CELL)

    places = own.select("doc_id", "low", "bands")
    left = stash(dealt(met.join(places, "doc_id").select(*CELL, *MEMBER, "low", "bands")).mapInArrow(_by_cell(open_members), SCHEMA), "open")
    texts = _texts(docs, left, id_col=id_col, text_col=text_col)
    rows = left.join(places, "doc_id").join(texts, "doc_id").select(*CELL, *MEMBER, "low", "bands", "text")
    out = stash(dealt(rows).mapInArrow(_by_cell(decide), "u long, v long"), "cell_links")
    unstash(texts)
    unstash(left)
    return out


def similar_groups(docs: DataFrame, others: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(node, component) of the documents linked by similarity; others are more groups of candidates (doc_id, hub)."""
    options = {"id_col": id_col, "text_col": text_col, "shingle": shingle}
    least = fewest(similarity)
    signed = stash(signatures(docs, **options, seed=seed), "signatures")
    # One document stands for all with its set of shingles.
    lone = signed.groupBy("all").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("bands", "low", "size"), "doc_id").alias("of"))
    lone = stash(lone.select("doc_id", "of.bands", "of.low", "of.size", "all"), "lone")
    equal = stash(signed.join(lone.select("all", F.col("doc_id").alias("first")), "all").where("doc_id <> first").select("doc_id", "first").distinct(), "equal")
    unstash(signed)
    member = lone.select("doc_id", F.explode("bands").alias("key")).distinct()
    groups = member.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub <> last").select("key", "hub")
    grouped = member.join(groups, "key").select(F.lit(0).cast("long").alias("kind"), "key", "doc_id", "hub")
    if others is not None:
        for c in ("doc_id", "hub"):
            others = others.join(equal.select(F.col("doc_id").alias(c), F.col("first").alias("_first")), c, "left").withColumn(c, F.coalesce("_first", c)).drop("_first")
        more = others.unionByName(others.select(F.col("hub").alias("doc_id"), "hub")).distinct()
        grouped = grouped.unionByName(more.select(F.lit(1).cast("long").alias("kind"), F.col("hub").alias("key"), "doc_id", "hub"))
    grouped = stash(grouped, "grouped")
    own = stash(lone.join(grouped.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "low", "bands", "size"), "own")
    unstash(lone)
    edges = grouped.where("doc_id <> hub").select(F.greatest("doc_id", "hub").alias("u"), F.least("doc_id", "hub").alias("v")).distinct()
    both = edges.join(own.select(F.col("doc_id").alias("u"), F.col("low").alias("x")), "u").join(own.select(F.col("doc_id").alias("v"), F.col("low").alias("y")), "v")
    rated = stash(both.select("u", "v", "x", "y").mapInArrow(agreeing(least), "u long, v long"), "rated")
    found = decided(docs, rated, **options, similarity=similarity)
    labels = stash(components(found), "labels")
    late = links_in_cells(docs, cells(grouped, own, labels), own, **options, seed=seed, least=least, similarity=similarity)
    if not late.isEmpty():
        # Links between groups found so far join whole groups.
        name = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_"))
        late = late.join(name("u"), "u", "left").join(name("v"), "v", "left").select(F.coalesce("u_", "u").alias("u"), F.coalesce("v_", "v").alias("v"))
        tops = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
        labels = stash(components(tops.unionByName(late)), "labels")
    for table in (grouped, own, rated, found):
        unstash(table)
    copies = equal.join(labels.withColumnRenamed("node", "first"), "first", "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "first").alias("component"))
    return labels.unionByName(copies)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """docs with the smallest id of each group of near-copies only; all columns kept, see keep_one()."""

    def dropped(rows, own):
        near = near_duplicates(rows, id_col=own, text_col=text_col, shingle=shingle, radius=radius)
        found = near.where("doc_id <> component_id").select("doc_id", F.col("component_id").alias("hub"))
        groups = similar_groups(rows, found, id_col=own, text_col=text_col, shingle=shingle, similarity=similarity)
        return groups.where("node <> component").select(F.col("node").alias("doc_id"))

    return keep_one(docs, dropped, id_col=id_col, text_col=text_col)

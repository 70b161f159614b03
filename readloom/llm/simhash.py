"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints. A-Z are lower-cased, words are runs of anything but the six ASCII
white-space characters, and each run of `shingle` words (repeats included; the
whole sequence if there are fewer) is hashed with XXH64. A bit is set if it is set
in over half of the hashes. A text that is null or has no word has fingerprint 0.

Links. Two fingerprints link at `radius` or fewer differing bits. One index over all
distinct fingerprints finds the links. They are sorted by Gray rank, where neighbours
share long bit patterns. A lowest node covers TWIG neighbours and holds the bits on
which they agree; a node above covers 2 ** FAN_BITS neighbouring nodes and holds the bits on which those
agree. The search goes down from the root with pairs of nodes: both are replaced by
their children, only the agreed bits that no pair of ancestors has compared are
compared, the differences add up, and a pair of nodes goes, with all that lies below
it, once they exceed the radius. The members of pairs of lowest nodes that remain are
compared in full.

The upper levels are tables, searched in equi joins on the parent. From the level of
leaf_size() on, which follows the number of fingerprints, the nodes travel as leaves
with all their members: a pair of leaves that remains goes to a task with what its
ancestors have compared, and the task goes down the levels that are left.

Skew. All rows with one fingerprint are one entry, so a leaf has a bounded number of
members whatever the copies. Levels, pairs of nodes and leaves are tables that Spark
deals out by node. A pair of leaves hands on the edges of a spanning forest of its
links, at most two leaves of them, not all pairs.

Defined results: null and wordless texts share fingerprint 0 and link like any
other; rows with a null id have a null component and do not link; rows that repeat
an id count under that id; other columns are left out.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import fresh, pieces, stash, utf8
from readloom.llm.graph import components
from readloom.operators.ordering import numbered

TWIG, FAN_BITS = 64, 4  # members of a lowest node; other nodes have 2 ** FAN_BITS children
LEAVES = 64  # leaves beyond which the next level is taken for them
LEAF = TWIG << 2 * FAN_BITS  # members of a leaf at most
PAIRS = 64  # pairs of leaves that a task compares
SLICE = 128  # pairs of lowest nodes that are compared at once


def leaf_size(n: int) -> int:
    """The members of a leaf among n fingerprints: those of a node of some level."""
    size = TWIG
    while size < LEAF and n > LEAVES * size:
        size <<= FAN_BITS
    return size


def fingerprint(text: bytes | None, shingle: int, seed: int) -> int:
    """The fingerprint of one UTF-8 text, as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the SimHash of each whole text."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                fps = [fingerprint(t, shingle, seed) for t in utf8(part.column("text"))]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": pa.array(fps, pa.int64())})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """The position of a 64-bit pattern in the Gray sequence, as a long of the same order."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def leaves(distinct: DataFrame, size: int) -> DataFrame:
    """(node, low, high, members): leaves of neighbours in Gray order, numbered in that order.

    low and high are the AND and the OR of the members: these agree on a bit where both do.
    """

    def pack(batches):
        part, k, rest = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)
        for batch in [*batches, None]:
            x = rest if batch is None else np.concatenate([rest, batch.column("fp").to_numpy()])
            whole = len(x) if batch is None else len(x) // size * size
            if whole:
                starts = np.arange(0, whole, size)
                low, high = np.bitwise_and.reduceat(x[:whole], starts), np.bitwise_or.reduceat(x[:whole], starts)
                members = [x[a : min(a + size, whole)].tobytes() for a in starts]
                yield pa.record_batch({"part": pa.array(np.full(len(starts), part, np.int32)), "k": pa.array(k + np.arange(len(starts))), "low": pa.array(low), "high": pa.array(high), "members": pa.array(members, pa.binary())})
                k += len(starts)
            rest = x[whole:]

    ordered = distinct.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange("rank").sortWithinPartitions("rank").select("fp")
    packed = stash(ordered.mapInArrow(pack, "part int, k long, low long, high long, members binary"), "leaves")
    sizes = packed.groupBy("part").agg(F.count("*").alias("n"))  # one row per task that packed
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return packed.join(F.broadcast(before), "part").select((F.col("before") + F.col("k")).alias("node"), "low", "high", "members")


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, lowest member of its tree) that connect what the edges between 0 .. n - 1 connect."""
    low = np.arange(n)

    def root(i):
        while (up := low[i] != i).any():
            i = np.where(up, low[i], i)
        return i

    while len(u):
        ru, rv = root(u), root(v)
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(low, np.maximum(ru, rv), np.minimum(ru, rv))
    top = root(np.arange(n))
    off = np.flatnonzero(top != np.arange(n))
    return off, top[off]


def _agreed(x: np.ndarray, size: int):
    """(bits, which of them all members agree on) of each run of `size` members."""
    starts = np.arange(0, len(x), size)
    low, high = np.bitwise_and.reduceat(x, starts), np.bitwise_or.reduceat(x, starts)
    return low, ~(low ^ high)


def near_pairs(x: np.ndarray, y: np.ndarray, radius: int, own: bool, **options):
    """Places (i, j) of the members of two leaves within the radius; of one leaf with itself i < j."""
    found = list(near_slices(x, y, radius, own, **options))
    return [np.concatenate(z) for z in zip(*found)] if found else [np.zeros(0, np.int64)] * 2


def near_slices(x: np.ndarray, y: np.ndarray, radius: int, own: bool, seen: int = 0, far: int = 0, twig: int = TWIG, watch: list | None = None):
    """near_pairs() in slices of at most SLICE pairs of lowest nodes.

    seen are the bits that ancestors have compared, far how many of them differ. watch
    gets (members of a node, pairs of nodes, pairs that stay) of each level.
    """
    sizes = [twig]
    while sizes[0] << FAN_BITS < max(len(x), len(y)):
        sizes.insert(0, sizes[0] << FAN_BITS)
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    seen, far = np.full(1, seen, np.uint64), np.full(1, far, np.int64)
    for k, size in enumerate(sizes):
        (low_x, mask_x), (low_y, mask_y) = _agreed(x, size), _agreed(y, size)
        fan = 1 << FAN_BITS if k else max(len(low_x), len(low_y))
        child = np.arange(fan)
        pp, qq = np.broadcast_arrays((p * fan)[:, None, None] + child[:, None], (q * fan)[:, None, None] + child)
        there = (pp < len(low_x)) & (qq < len(low_y)) & ((pp <= qq) | (not own))
        seen, far = (np.broadcast_to(z[:, None, None], pp.shape)[there] for z in (seen, far))
        p, q = pp[there], qq[there]
        new = mask_x[p] & mask_y[q] & ~seen
        far = far + np.bitwise_count((low_x[p] ^ low_y[q]) & new)
        stay = far <= radius
        if watch is not None:
            watch.append((size, len(stay), int(stay.sum())))
        p, q, seen, far = p[stay], q[stay], (seen | new)[stay], far[stay]
    (a, here), (b, there) = _rows(x, twig), _rows(y, twig)
    for at in range(0, len(p), SLICE):
        pp, qq = p[at : at + SLICE], q[at : at + SLICE]
        close = np.bitwise_count(a[pp][:, :, None] ^ b[qq][:, None, :]) <= radius
        close &= here[pp][:, :, None] & there[qq][:, None, :]
        if own:
            close[pp == qq] &= np.triu(np.ones((twig, twig), bool), 1)
        k, i, j = np.nonzero(close)
        yield pp[k] * twig + i, qq[k] * twig + j


def _rows(x: np.ndarray, twig: int):
    """The members in rows of a lowest node each, and which of them are there."""
    rows = -(-len(x) // twig)
    out, there = np.zeros((rows, twig), np.uint64), np.arange(rows * twig).reshape(rows, twig) < len(x)
    out[there] = x
    return out, there


def _compare(radius: int):
    """The links between the members of two leaves, for each pair of leaves."""

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for a, b, x, y, seen, far in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y", "seen", "far"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = x if a == b else np.concatenate([x, y])
                u = v = np.zeros(0, np.int64)
                for i, j in near_slices(x, y, radius, a == b, seen=seen & (1 << 64) - 1, far=far):
                    u, v = np.concatenate([u, i]), np.concatenate([v, j + (0 if a == b else len(x))])
                    if len(u) > 2 * (len(x) + len(y)):  # links of large groups are cut to a forest as they come
                        u, v = spanning(u, v, len(both))
                if len(u) > len(x) + len(y):
                    u, v = spanning(u, v, len(both))
                us.append(both[u])
                vs.append(both[v])
            if us:
                yield pa.record_batch({"u": pa.array(np.concatenate(us).view(np.int64)), "v": pa.array(np.concatenate(vs).view(np.int64))})

    return run


def links(distinct: DataFrame, *, radius: int = 2, leaf: int | None = None, fan_bits: int = FAN_BITS) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints (fp) linked within the radius."""
    bottom = leaves(distinct, leaf or leaf_size(distinct.count()))
    levels = [stash(bottom.select("node", "low", "high"), "level")]
    n = levels[0].count()
    while n > 1:
        above = levels[-1].groupBy(F.shiftright("node", fan_bits).alias("node")).agg(F.bit_and("low").alias("low"), F.bit_or("high").alias("high"))
        levels.append(stash(above, "level"))
        n = -(-n // (1 << fan_bits))

    def side(s):
        """The children of a level's nodes as one side of a pair."""
        return [F.shiftright("node", fan_bits).alias("up"), F.col("node").alias(s), F.col("low").alias(f"{s}_low"), F.bitwise_not(F.col("low").bitwiseXOR(F.col("high"))).alias(f"{s}_mask")]

    root = levels[-1].select(*side("a")[1:]).withColumns({"b": F.col("a"), "b_low": F.col("a_low"), "b_mask": F.col("a_mask")})
    pairs = root.withColumns({"seen": F.col("a_mask"), "far": F.lit(0)})
    new = F.col("a_mask").bitwiseAND(F.col("b_mask")).bitwiseAND(F.bitwise_not("seen"))
    added = F.bit_count(F.col("a_low").bitwiseXOR(F.col("b_low")).bitwiseAND(new))
    for level in reversed(levels[:-1]):
        for s in "ab":
            old = [c for c in pairs.columns if not c.startswith(s)]
            pairs = pairs.select(F.col(s).alias("up"), *old).join(level.select(*side(s)), "up").drop("up")
            pairs = pairs.withColumns({"far": F.col("far") + added, "seen": F.col("seen").bitwiseOR(new)}).where(F.col("far") <= radius)
        pairs = stash(pairs.where("a <= b"), "pairs")
    pairs = pairs.select("a", "b", "seen", "far").repartition(-(-pairs.count() // PAIRS) or 1)
    for s, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(bottom.select(F.col("node").alias(s), F.col("members").alias(name)), s)
    return pairs.select("a", "b", "x", "y", "seen", "far").mapInArrow(_compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed), component_id, the smallest id that links reach."""
    fps = stash(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "fps")
    distinct = stash(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    joined = components(links(distinct, radius=radius)).withColumnRenamed("node", "fp")
    entry = distinct.join(joined, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    smallest = entry.groupBy("component").agg(F.min("low").alias("component_id"))
    member = entry.join(smallest, "component").select("fp", "component_id")
    return fps.join(member, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def simhash_query(docs: DataFrame) -> DataFrame:
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return near_duplicates(docs).select("doc_id", hex_.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the smallest id of each group of near-duplicates only; see keep_one()."""

    def dropped(rows, own):
        return near_duplicates(rows, id_col=own, text_col=text_col, **options).where("doc_id <> component_id").select("doc_id")

    return keep_one(docs, dropped, id_col=id_col, text_col=text_col)


def keep_one(docs: DataFrame, dropped, *, id_col: str, text_col: str) -> DataFrame:
    """docs without the rows whose id dropped(rows, id column) names; all columns kept, under any names.

    Rows that repeat id and text are one document, of which any one row stays. Rows of
    one id with different texts are documents of their own: if there are any, all
    documents are numbered by id and hash of the text, and the number takes the id's
    place. Rows with a null id all stay.
    """
    gone, twice, version = (fresh(docs.columns, n) for n in ("gone", "twice", "version"))
    key, hash_ = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(text_col))
    known = docs.where(key.isNotNull()).groupBy(key.alias(twice)).agg(F.count("*").alias("n"), F.min(hash_).alias("a"), F.max(hash_).alias("b"))
    known = stash(known.where("n > 1").select(twice, (F.col("a") != F.col("b")).alias("several")), "twice")
    rows, own, repeated = docs, id_col, known.select(twice)
    if not known.where("several").isEmpty():
        own = fresh(docs.columns, "own")
        pairs = docs.where(key.isNotNull()).groupBy(key.alias(twice), hash_.alias(version)).agg(F.count("*").alias("n"))
        number = numbered(pairs, [F.col(twice), F.col(version)], own)
        rows = docs.join(number.drop("n"), (key == F.col(twice)) & (hash_ == F.col(version)), "left").drop(twice, version)
        repeated = number.where("n > 1").select(F.col(own).alias(twice))
    on = F.col(f"`{own}`").cast("long")
    left = rows.join(stash(dropped(rows, own).select(F.col("doc_id").alias(gone)), "gone"), on == F.col(gone), "left_anti")
    if not repeated.isEmpty():
        one = left.join(repeated, on == F.col(twice), "left_semi").dropDuplicates([own])
        left = left.join(repeated, on == F.col(twice), "left_anti").unionByName(one)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])

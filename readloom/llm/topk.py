"""Exact top-k inner products over norm-sorted blocks.

Components become integers floor(scale * x). Candidates are sorted by descending
length, cut into blocks and numbered in that order. Vectors are rotated by the SVD of
the candidates' second moments, so that the leading coordinates carry most of the
products: the partial sum over them plus the Cauchy-Schwarz bound on the residuals
(the product of the lengths of what is left) is an upper bound of the score, and
pairs below a query's floor are not computed further. The floors come from a first
pass of each query over the block of longest candidates. Queries are then sorted by
floor over length, the length that a candidate must have, and cut into blocks of
neighbours, so that one weak query does not open the candidates for others: a block of
queries meets the first m candidate blocks only, where m comes from the counts of
blocks by length. Neighbouring candidate blocks form groups of bounded size; a block of
queries is sent once to each group that it meets, where a task holds the candidates and
passes the queries by them, with floors that rise on the way. So nothing is joined, and no
table of blocks can be taken for a small one and broadcast. What survives the bounds is
scored in integers, or as whole products where most of two blocks survive and doubles
hold every sum; all bounds are rounded up, so results are exact.

Defined results: vectors that are null, or hold a null or a non-finite component
(before or after scaling), take no part; a shorter vector counts as if it went on with
zeros; a score beyond a long is the nearest long; a query with fewer candidates gets
all; ties go to the smaller id; a query is not its own candidate (by id); rows with a
null id take no part; rows that repeat an id are candidates of their own; empty tables
give no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import stash

LEAD = 16
ROTATED = 1024  # components that are rotated; those behind them count in the residual
BLOCK_BYTES = 8 << 20  # of a block's vectors, unless one vector is longer
GROUP_BYTES = 32 << 20  # of the candidates that a task holds, unless one block is larger
LONG = (1 << 63) - 1


def _usable(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v, norm): integers as doubles, which are exact at any size."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(float(scale))).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x))
    rows = rows.where(finite & (F.size(v) > 0)).select("id", whole.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column) -> np.ndarray:
    """A column of arrays as rows, with zeros behind the shorter ones."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(n.max(initial=1))))
    out[np.arange(out.shape[1]) < n[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _slices(batch, most: int):
    """Slices of a batch of at most `most` rows, and fewer where their vectors are long."""
    n = np.diff(batch.column("v").offsets.to_numpy())
    rows = max(1, min(most, BLOCK_BYTES // (8 * int(n.max(initial=1)))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


BLOCK = "ids binary, vectors binary, width int"


def _block(rows) -> dict:
    """The columns of BLOCK for a slice of rows; whole numbers take as many bytes as they need."""
    m = _matrix(rows.column("v"))
    most = np.abs(m).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return {"ids": pa.array([rows.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([m.astype(kind).tobytes()], pa.binary()), "width": pa.array([m.shape[1]], pa.int32())}


def _open(ids: bytes, vectors: bytes, width: int):
    ids = np.frombuffer(ids, "<i8")
    kind = {2: "<i2", 4: "<i4", 8: "<f8"}[len(vectors) // (len(ids) * width)]
    return ids, np.frombuffer(vectors, kind).reshape(len(ids), width).astype("<f8")


def _level(length):
    """A step of a sixteenth of an octave; longer vectors are on higher steps."""
    with np.errstate(divide="ignore"):
        return np.floor(16 * np.log2(np.maximum(length, 2.0**-60))).astype(np.int64)


def _rotated(m: np.ndarray, rotation: np.ndarray):
    """(leading coordinates, length of the rest, length) of each row."""
    d = min(m.shape[1], len(rotation))
    r = m[:, :d] @ rotation[:d]
    rest = (r[:, LEAD:] ** 2).sum(1) + (m[:, d:] ** 2).sum(1)
    return r[:, :LEAD], np.sqrt(rest), np.sqrt((m**2).sum(1))


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, to the nearest long."""
    if not len(q):
        return np.zeros(0, np.int64)
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 1 << 52:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)  # every partial sum is exact
    if np.abs(q).max() < 1 << 53 and np.abs(c).max() < 1 << 53 and np.abs(q).max() * np.abs(c).max() * q.shape[1] < 1 << 62:
        return np.einsum("ij,ij->i", q.astype(np.int64), c.astype(np.int64))
    found = (sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q, c))
    return np.array([min(max(s, -LONG - 1), LONG) for s in found], np.int64)


def _top(rows, ids, score, k: int) -> np.ndarray:
    """Which entries are among the k best of their row, by row and rank."""
    order = np.lexsort((ids, ~score, rows))
    first = np.searchsorted(rows[order], rows[order], side="left")
    return order[np.arange(len(order)) - first < k]


def _raised(floor, rows, score, k: int) -> np.ndarray:
    """The floors, or the k-th score of the rows that have k if that is higher."""
    n = np.bincount(rows, minlength=len(floor))
    np.minimum.at(low := np.full(len(floor), LONG), rows, score)
    return np.where(n >= k, np.maximum(floor, low), floor)


def best(qi, q, ci, c, rotation, floor, k: int):
    """(query row, candidate row, score): per query, its k best candidates that are not below its floor."""
    return _best(qi, q, _rotated(q, rotation), ci, c, _rotated(c, rotation), floor, k)


def _best(qi, q, q_parts, ci, c, c_parts, floor, k: int):
    width = min(q.shape[1], c.shape[1])
    (ql, qr, qn), (cl, cr, cn) = q_parts, c_parts
    with np.errstate(invalid="ignore", over="ignore"):
        bound = ql @ cl.T + np.outer(qr, cr)
        bound += 1e-9 * np.outer(qn, cn) + 1e-6
    # A bound that is no number bounds nothing, and where there is no floor nothing goes.
    left = ~(bound < floor[:, None])
    left[floor == -LONG - 1] = True
    left &= qi[:, None] != ci[None, :]
    if np.count_nonzero(left) > left.size // 32 and np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width < 1 << 52:
        whole = np.where(left, q[:, :width] @ c[:, :width].T, -np.inf)  # every partial sum is exact
        near = left & (whole >= floor[:, None])
        open_ = np.flatnonzero(np.count_nonzero(near, axis=1) > 64 + k)
        if len(open_):  # only what reaches the row's own k-th score
            near[open_] &= whole[open_] >= np.partition(whole[open_], -k, axis=1)[:, -k][:, None]
        rows, columns = np.nonzero(near)
        score = whole[rows, columns].astype(np.int64)
    else:
        rows, columns = np.nonzero(left)
        score = np.concatenate([exact(q[rows[a : a + 65536], :width], c[columns[a : a + 65536], :width]) for a in range(0, len(rows), 65536)] or [np.zeros(0, np.int64)])
        near = score >= floor[rows]
        rows, columns, score = rows[near], columns[near], score[near]
    top = _top(rows, ci[columns], score, k)
    return rows[top], columns[top], score[top]


def _rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The SVD rotation of the vectors' directions; width x width sums come to the driver, whatever the number of rows."""

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for part in _slices(batch, 4096):
                m = _matrix(part.column("v"))[:, :width]
                m = m / np.maximum(np.abs(m).max(1, keepdims=True, initial=0), 1)
                m = m / np.maximum(np.sqrt((m**2).sum(1, keepdims=True)), 1e-12)
                total[: m.shape[1], : m.shape[1]] += m.T @ m
        yield pa.record_batch({"i": pa.array(np.arange(width)), "row": pa.array(list(total), pa.list_(pa.float64()))})

    summed = rows.select("v").mapInArrow(moments, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    second = np.zeros((width, width))
    second[summed["i"].to_numpy(), summed["j"].to_numpy()] = summed["x"].to_numpy()
    return np.linalg.svd(second)[0]


def _candidate_blocks(rows: DataFrame, most: int) -> DataFrame:
    """(number, top, ids, vectors, width): blocks in descending order of length."""

    def pack(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for own in _slices(batch, most):
                yield pa.record_batch({"part": pa.array([part], pa.int32()), "k": pa.array([k]), "top": pa.array([own.column("norm")[0].as_py()])} | _block(own))
                k += 1

    keys = [F.desc("norm"), F.col("id")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "v", "norm")
    packed = stash(ordered.mapInArrow(pack, f"part int, k long, top double, {BLOCK}"), "blocks")
    sizes = packed.groupBy("part").agg(F.count("*").alias("n"))  # one row per task that packed
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return packed.join(F.broadcast(before), "part").select((F.col("before") + F.col("k")).alias("number"), "top", "ids", "vectors", "width")


def _floors(asked: DataFrame, longest: DataFrame, rotation: np.ndarray, k: int, most: int) -> DataFrame:
    """(id, v, floor, need): each query with the k-th best score among the longest candidates, and the length it asks of others."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                qi, q = _open(r["ids"], r["vectors"], r["width"])
                ci, c = _open(r["c_ids"], r["c_vectors"], r["c_width"])
                floor = np.full(len(qi), -LONG - 1, np.int64)
                row, _, score = best(qi, q, ci, c, rotation, floor, k)
                floor = _raised(floor, row, score, k)
                with np.errstate(invalid="ignore"):
                    need = np.where(floor > 0, floor / np.maximum(np.sqrt((q**2).sum(1)), 1e-300), 0.0)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), q.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch({"id": pa.array(qi), "v": flat, "floor": pa.array(floor), "need": pa.array(need)})

    def pack(batches):
        for batch in batches:
            for own in _slices(batch, most):
                yield pa.record_batch({"number": pa.array([0], pa.int64())} | _block(own))

    asking = stash(asked.select("id", "v").mapInArrow(pack, f"number long, {BLOCK}"), "asking")
    # The block of the longest is one row of bounded size.
    joined = asking.join(F.broadcast(longest.select("number", F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"), F.col("width").alias("c_width"))), "number")
    return joined.select("ids", "vectors", "width", "c_ids", "c_vectors", "c_width").mapInArrow(run, "id long, v array<double>, floor long, need double")


def top_k(candidates: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, block: int = 4096, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query, exactly."""
    rows = stash(_usable(candidates, id_col, vector_col, scale), "vectors")
    asked = _usable(queries, id_col, vector_col, scale)
    widest = rows.agg(F.max(F.size("v"))).first()[0]
    if not widest:
        return candidates.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rotation = _rotation(rows, min(widest, ROTATED))
    blocks = _candidate_blocks(rows, block)
    floors = stash(_floors(asked, blocks.where("number = 0"), rotation, k, query_block), "floors")

    # How many blocks reach a length: a row per step of a sixteenth of an octave.
    level = lambda c: F.floor(F.lit(16) * F.log2(F.greatest(c, F.lit(2.0**-60))))
    counts = blocks.groupBy(level(F.col("top")).alias("level")).agg(F.count("*").alias("n"), F.max(F.octet_length("ids") * F.col("width")).alias("bytes")).collect()
    steps = sorted(((r.level, r.n) for r in counts), reverse=True)
    step, reach = np.array([-s for s, _ in steps]), np.concatenate([[0], np.cumsum([n for _, n in steps])])

    def pack(batches):
        for batch in batches:
            for own in _slices(batch, query_block):
                # One step of slack makes up for rounding.
                least = _level(own.column("need").to_numpy().min()) - 1
                m = int(reach[np.searchsorted(step, -least, side="right")]) if own.column("need").to_numpy().min() > 0 else int(reach[-1])
                yield pa.record_batch({"m": pa.array([m])} | _block(own) | {"floors": pa.array([own.column("floor").to_numpy().astype("<i8").tobytes()], pa.binary())})

    alike = floors.repartitionByRange("need", "id").sortWithinPartitions("need", "id").select("id", "v", "floor", "need")
    asking = stash(alike.mapInArrow(pack, f"m long, {BLOCK}, floors binary"), "asking")
    met = asking.agg(F.max("m")).first()[0] or 0  # blocks that some query meets

    # A group is a few blocks that a task can hold; there are some groups for each core.
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    per = max(1, min(GROUP_BYTES // max(r.bytes for r in counts), -(-met // (4 * cores))))
    groups = max(1, -(-met // per))
    held = blocks.where(F.col("number") < met).select(F.floor(F.col("number") / per).alias("group"), F.lit(0).alias("kind"), F.col("number").alias("at"), "ids", "vectors", "width", F.lit(b"").alias("floors"))
    passing = asking.where("m > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / per))).alias("group"), F.lit(1).alias("kind"), F.col("m").alias("at"), "ids", "vectors", "width", "floors")
    pairs = held.union(passing).repartitionByRange(groups, "group").sortWithinPartitions("group", "kind", "at")

    def score(batches):
        group, own = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["group"] != group:
                    group, own = r["group"], []
                ids, v = _open(r["ids"], r["vectors"], r["width"])
                parts = _rotated(v, rotation)
                if r["kind"] == 0:
                    own.append((r["at"], ids, v, parts))
                    continue
                floor = np.frombuffer(r["floors"], "<i8")
                row, found, value = (np.zeros(0, np.int64) for _ in range(3))
                for number, ci, c, c_parts in own:
                    if number >= r["at"]:
                        break
                    more, column, scores = _best(ids, v, parts, ci, c, c_parts, floor, k)
                    row, found, value = (np.concatenate(x) for x in ((row, more), (found, ci[column]), (value, scores)))
                    top = _top(row, found, value, k)
                    row, found, value = row[top], found[top], value[top]
                    floor = _raised(floor, row, value, k)
                yield pa.record_batch({"query_id": pa.array(ids[row]), "vec_id": pa.array(found), "score": pa.array(value)})

    scored = pairs.mapInArrow(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k_query(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q, v WHERE q.query_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

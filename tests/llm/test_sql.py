"""The operators that SQL can express equal DuckDB."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from readloom.llm import linededup, mixing, queries, topk


def compare(con, sql, out):
    columns = sorted(out.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in out.collect()) == sorted(repr([r[i] for i in place]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    compare(con, queries.SQL[name], queries.QUERIES[name](spark, sf_dir))


def test_line_dedup_edges(spark):
    lines = "a\nb\nc"
    rows = [(1, lines, "x"), (2, f"{lines}\nd\n{lines}", "x"), (3, None, "x"), (4, "", "x"), (5, "a\nb", "x"), (6, "z\nz\nz\nz\nz", "x"), (None, lines, "x"), (7, "q\r\n\n\n\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, covered string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linededup.line_dedup(docs).collect()}
    assert got[None] == (3, 0, lines)  # a null id sorts first
    assert got[1] == (3, 3, "") and got[2] == (7, 6, "d")
    assert got[3] == (0, 0, None) and got[4] == (1, 0, "") and got[5] == (2, 0, "a\nb")
    assert got[6] == (5, 4, "z")  # windows 2 and 3 repeat window 1 of the same document
    assert got[7] == (5, 3, "q\r\n")
    assert linededup.line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "d\ne\nf")], "doc_id long, text string")
    assert sorted(r.text for r in linededup.line_dedup(docs).collect()) == ["a\nb\nc", "a\nb\nc", "d\ne\nf"]


def brute_mix(docs, repetition):
    import hashlib
    import math

    sums = {}
    for _, _, source, n in docs:
        sums.setdefault(source, [0, 0])
        sums[source][0] += 1
        sums[source][1] += n
    total = sum(n for _, n in sums.values())

    def spread(t):
        r = [(n / total) ** t / (n / total) for _, n in sums.values()]
        return max(r) / min(r)

    lo, hi = 0.0, 1.0
    if spread(0) <= repetition:
        hi = 0.0
    else:
        for _ in range(50):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if spread(mid) <= repetition else (mid, hi)
    t = min(1, math.ceil(round(hi * 1e6, 3)) / 1e6)
    low = max(n / n**t for _, n in sums.values())
    out = []
    for source, (count, n) in sums.items():
        quota = max(n, round(n**t * low))
        for k in range(1, math.ceil(quota / n) + 1):
            own = [d for d in docs if d[2] == source]
            order = lambda d: int(hashlib.md5(f"{'' if d[0] is None else d[0]}|{k}|0".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
            own.sort(key=lambda d: (order(d) % math.ceil(count / 4), order(d), d[0]))  # noqa: B023
            start = 0
            for d in own:
                if k * n <= quota or start < quota - (k - 1) * n:
                    out.append((d[0], source, k))
                start += d[3]
    return sorted(out, key=repr)


def test_mix_brute_force(spark):
    docs = [(i, "w " * (1 + i * 7 % 30), None if i % 11 == 0 else "big" if i % 3 else f"s{i % 2}", 1 + i * 7 % 30) for i in range(120)]
    df = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, source string")
    for repetition in (1.5, 2.0, 50.0):
        got = sorted(((r.doc_id, r.source, r["pass"]) for r in mixing.mix(df, repetition=repetition, block=4).collect()), key=repr)
        assert got == brute_mix(docs, repetition)


def test_mix_budget_and_entropy(spark):
    rows = [(i, "a b c d", "x" if i < 90 else "y") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, budget=200, repetition=None, entropy=0.6, block=8)
    taken = dict(got.groupBy("source").sum("tokens").collect())
    import math

    w = taken["y"] / sum(taken.values())
    assert abs(sum(taken.values()) - 200) <= 8
    assert -(w * math.log(w) + (1 - w) * math.log(1 - w)) <= 0.62


def test_mixed_keeps_columns_and_rows(spark):
    rows = [(1, "a", "x", 5), (None, None, None, 6), (2, "", "y", 7), (2, "", "y", 8), (3, "a b c d e f g", "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pass int")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert {r["pass"] for r in out.collect()} == {5, 6, 7, 8, 9}
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mixed_has_the_rows_of_the_mix(spark):
    rows = [(1, "a b", "x", k) for k in range(10)] + [(1, "a b", "y", 10), (2, "c", "y", 11), (None, None, None, 12), (None, None, None, 12), (None, "q r s t u v w", "z", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _key int").withColumnsRenamed({}).selectExpr("*", "1 as _n", "2 as copies", "3 as left", "4 as row")
    for block in (2, 4096):
        out = mixing.mixed(df, block=block)
        assert out.columns == df.columns
        taken = sorted(((r.doc_id, r.source, r.n) for r in mixing.mix(df, block=block).groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()), key=repr)
        assert sorted(((r.doc_id, r.source, r.n) for r in out.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()), key=repr) == taken
        each = [r["count"] for r in out.where("source = 'x'").groupBy("_key").count().collect()]
        assert len(each) == 10 and max(each) - min(each) <= 1


def test_mixed_keeps_map_columns(spark):
    rows = [(1, "a b", "x", {"k": "1", "j": None}, [{"m": k}]) for k in range(5)] + [(1, "a b", "x", None, None)] * 2 + [(2, "c d e f g h", "y", {}, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,string>, `deep.er` array<map<string,int>>")
    for block in (2, 4096):
        out = mixing.mixed(docs, block=block)
        assert out.schema == docs.schema
        got = out.collect()
        counts = sorted(sum(r["deep.er"] == [{"m": k}] for r in got) for k in range(5))
        assert counts[-1] - counts[0] <= 1 and any(r.tags == {} for r in got) and sum(r.tags is None for r in got) >= 2
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_top_k_brute_force(spark):
    import math
    import random

    random.seed(4)
    vectors = {i: [random.gauss(0, random.choice([0.1, 1, 3])) for _ in range(24)] for i in range(300)}
    vectors[301] = vectors[300] = vectors[7]
    vectors[450] = [1.0]
    bad = [(400, None), (401, [None] * 24), (402, [float("nan")] * 24), (403, [float("inf")] * 24), (404, []), (None, vectors[3])]
    df = spark.createDataFrame([*vectors.items(), *bad], "vec_id long, embedding array<float>")
    import numpy as np

    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors.items()}
    want = []
    for q in whole:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for block in (16, 4096):
        got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), block=block, query_block=3).collect())
        assert got == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2


def test_top_k_beyond_a_long_and_pruning(spark):
    import numpy as np

    rows = [(0, [1e8, 1.0]), (1, [3e38, 2.0]), (2, [1e8, 3.0]), (3, [-1e8, 1.0]), (50, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = {i: [int(256 * float(np.float32(x))) for x in v] for i, v in rows}
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = []
    for q in (0, 50):
        best = sorted((-clip(sum(a * b for a, b in zip(exact[q], exact[i]))), i) for i in exact if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect())) == sorted(want)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 32))
    x = np.floor(256 * (base[rng.integers(0, 8, 4000)] + 0.05 * rng.normal(size=(4000, 32))))
    rotation = np.linalg.svd(x.T @ x)[0]
    ids = np.arange(4000)
    score = (x[:20] @ x.T).astype(np.int64)
    floor = np.sort(np.where(ids[:20, None] == ids, -(2**62), score), axis=1)[:, -5]
    seen = []
    whole = topk.exact
    topk.exact = lambda q, c: seen.append(len(q)) or whole(q, c)
    try:
        row, _, _ = topk.best(ids[:20], x[:20], ids, x, rotation, floor, 5)
    finally:
        topk.exact = whole
    assert (np.bincount(row) == 5).all() and sum(seen) < 20 * 4000 / 4


def test_top_k_plan_has_no_cross_join(spark):
    df = spark.range(400).selectExpr("id as vec_id", "transform(sequence(1, 4), k -> cast((id * 7919 * k) % 101 as float) - 50) as embedding")
    out = topk.top_k(df, df.where("vec_id % 50 = 0"), block=16, query_block=3)
    plan = out._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and out.count() == 40


def test_top_k_broadcasts_no_block_once_for_each_other(spark):
    df = spark.range(400).selectExpr("id as vec_id", "transform(sequence(1, 4), k -> cast((id * 7919 * k) % 101 as float) - 50) as embedding")
    out = topk.top_k(df, df.where("vec_id % 50 = 0"), block=16, query_block=3)
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    below = [y for i, x in enumerate(lines) if "BroadcastExchange" in x for j, y in enumerate(lines) if j > i and min(depth[i + 1 : j + 1]) > depth[i]]
    assert below and not [x for x in below if "Generate" in x]


def test_top_k_groups_of_wide_odd_and_negative_vectors(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(8)
    scale = rng.choice([1, 300, 70000, 1e10], 600)[:, None]
    vectors = np.floor(scale * rng.normal(size=(600, 40)))
    vectors[::3] = -np.abs(vectors[::3])
    vectors[100:160] = vectors[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = [[int(x) for x in v] for v in vectors]
    clip = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    want = []
    for q in range(0, 600, 50):
        ranked = sorted((-clip(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in enumerate(whole) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    for group_bytes in (1, 20000, topk.GROUP_BYTES):
        monkeypatch.setattr(topk, "GROUP_BYTES", group_bytes)
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), scale=1, block=16, query_block=3)
        assert sorted(map(tuple, got.collect())) == sorted(want)

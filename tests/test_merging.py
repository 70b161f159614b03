"""Merging sorted inputs: the order of a sort, ties, ranges of any number, and a plan without one."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.sources import merging

COLUMNS = "ord long, qname string, flag int, tid int, pos int, note string"


def rows(n, seed):
    rng = random.Random(seed)
    return [(k, rng.choice([None, "a", "b", "é", "zz", f"q{k % 7}"]), rng.choice([0, 16, 99]), *rng.choice([(None, None), (0, None), (rng.randrange(3), rng.randrange(40))]), f"{seed}/{k}") for k in range(n)]


def key(r, by_name):
    last = 2**31
    place = (last if r[3] is None else r[3], last if r[4] is None else r[4])
    name = (r[1] or "").encode()
    return (name, r[2], *place) if by_name else (*place, r[2], name)


@pytest.mark.parametrize("by_name", [False, True])
@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_same_order_as_a_sort(spark, tmp_path, by_name, ranges, monkeypatch):
    monkeypatch.setattr(merging, "BATCH", 64)
    inputs = [rows(700, 1), rows(300, 2), [], [(k, "a", 0, 1, 5, f"3/{k}") for k in range(500)]]
    paths = []
    for k, own in enumerate(inputs):
        paths.append(str(tmp_path / f"i{k}"))
        merging.write_sorted(spark.createDataFrame(own, COLUMNS), paths[-1], by_name)
    out = merging.merge_sorted(spark, paths, by_name=by_name, ranges=ranges, rank="rank").orderBy("rank").collect()
    want = sorted(((k, r) for k, own in enumerate(inputs) for r in own), key=lambda x: (key(x[1], by_name), x[0], x[1][0]))
    assert [(r.src, (r.ord, r.qname, r.flag, r.tid, r.pos, r.note)) for r in out] == want
    assert [r["rank"] for r in out] == list(range(1, len(want) + 1))


def test_streams_of_small_batches():
    import pyarrow as pa

    def batches(values, size):
        for at in range(0, len(values), size):
            yield merging.Keyed(pa.record_batch({"tid": pa.array(values[at : at + size], pa.int32()), "n": pa.array(range(at, min(at + size, len(values))))}), ("tid",))

    rng = random.Random(4)
    for size in (1, 2, 5, 100):
        inputs = [sorted(rng.randrange(9) for _ in range(rng.randrange(40))) for _ in range(5)]
        got = [(r["tid"], r["src"], r["n"]) for b in merging.merged([batches(v, size) for v in inputs], ("tid",)) for r in b.to_pylist()]
        assert got == sorted((t, k, n) for k, v in enumerate(inputs) for n, t in enumerate(v))


def test_plan_has_no_sort_and_no_shuffle(spark, tmp_path):
    paths = []
    for k in range(2):
        paths.append(str(tmp_path / f"i{k}"))
        merging.write_sorted(spark.createDataFrame(rows(200, k), COLUMNS), paths[-1])
    out = merging.merge_sorted(spark, paths, ranges=6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and len(sizes) == 6 and max(sizes) < 200

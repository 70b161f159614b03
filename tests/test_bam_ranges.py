"""BAM in ranges: every record once whatever its length and the range's; an index picks what is read; the layout prunes."""

import os
import random
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from readloom.fixtures import relation
from readloom.operators import filters, ordering
from readloom.schema import READS
from readloom.sources import bam, lines

BASES = "ACGT"
FIELDS = Row(*[f.name for f in READS])


def write(path, rows, contigs):
    """One file from rows of READS, by the writer's own parts."""
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in contigs)
    path.write_bytes(bam.compress(head) + bam.compress(b"".join(bam.encode(FIELDS(*r)) for r in rows)) + bam.EOF_BLOCK)


def long_rows(lengths, seed=5):
    rng = random.Random(seed)
    rows = []
    for k, n in enumerate(lengths):
        seq = "".join(rng.choices(BASES, k=n))
        rows.append((0, f"read{k}", 0, k % 3, 1 + k, 30, f"{n}M", None, None, 0, seq, "".join(rng.choices("!5?I", k=n)), None, None, {"XZ": {"type": "Z", "value": "y" * (n % 50)}}))
    return rows


@pytest.mark.parametrize("lengths", [[40] * 3000, [120_000] * 6, [300_000] * 3, [500_000, 40, 40, 90_000, 1, 65_000] * 2])
@pytest.mark.parametrize("split", [30_000, 70_000, 64 << 20])
def test_every_record_once(tmp_path, lengths, split):
    path = tmp_path / "x.bam"
    rows = long_rows(lengths)
    write(path, rows, [("a", 1000), ("b", 900), ("c", 10**9)])
    reader = bam.BamReader({"path": str(path), "split": str(split)})
    parts = reader.partitions()
    assert len(parts) == -(-path.stat().st_size // split)
    got = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert [r["qname"] for r in got] == [r[1] for r in rows] and [r["seq"] for r in got] == [r[10] for r in rows] and [r["qual"] for r in got] == [r[11] for r in rows]
    assert [r["ord"] for r in got] == sorted({r["ord"] for r in got})


def test_a_cut_record_is_an_error(tmp_path):
    path = tmp_path / "x.bam"
    write(path, long_rows([120_000] * 3), [("a", 1), ("b", 1), ("c", 1)])
    (tmp_path / "cut.bam").write_bytes(b"".join(path.read_bytes()[o : o + bam.block_size(path.read_bytes()[o : o + 64])] for o, _ in list(bam.blocks(str(path)))[:-3]))
    reader = bam.BamReader({"path": str(tmp_path / "cut.bam")})
    with pytest.raises(ValueError, match="cut off"):
        [b for p in reader.partitions() for b in reader.read(p)]


def test_starts_are_proven_not_guessed():
    data = bytearray(b"".join(bam.encode(FIELDS(*r)) for r in long_rows([50, 60, 70, 80, 90])))
    assert bam.verdict(data, 0, 3, False) is True
    assert bam.verdict(data[:100], 0, 3, False) is None and bam.verdict(data[:100], 0, 3, True) is False
    assert bam.verdict(data, 0, 1, True) is False  # contigs 1 and 2 are not known
    starts = [k for k in bam.candidates(data, 0, 3) if bam.verdict(data, k, 3, True)]
    size, want = 0, []
    while size < len(data):
        want.append(size)
        size += 4 + struct.unpack_from("<i", data, size)[0]
    assert starts == want


@pytest.fixture(scope="module")
def indexed(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "b")
    bam.register(spark)
    contigs = relation(spark, sf_dir, "contigs").selectExpr("cast(tid as int) tid", "name", "cast(length as int) length")
    # Spread over 500 kb, so that a contig has many windows.
    reads = relation(spark, sf_dir, "reads").withColumn("pos", F.col("pos") * 173)
    reads = reads.withColumn("tags", F.lit(None)).select(*[F.col(f.name).cast(f.dataType) for f in READS]).cache()
    reads.orderBy(*ordering.coordinate_keys()).write.format("bam").option("contigs", bam.contig_option(contigs)).mode("append").save(path)
    bam.write_index(spark, path)
    return reads, contigs, path


def names(rows):
    return sorted((r.region, r.qname, r.flag, r.pos) for r in rows.collect())


def test_region_scan_reads_few_ranges(spark, indexed):
    reads, contigs, path = indexed
    regions = ["ASIA:40,000-60000", "EUROPE:100000-100040", "AFRICA:9000000", "NOWHERE", "ASIA:-5"]
    want = names(filters.view_regions(reads, contigs, regions))
    assert want and names(bam.read_regions(spark, path, contigs, regions)) == want
    assert names(bam.read_regions(spark, path, contigs, regions, split=2000)) == want
    whole = bam.BamReader({"path": path})
    read = lambda r: sum(b.num_rows for p in r.partitions() for b in r.read(p))
    total = read(whole)
    some = read(bam.BamReader({"path": path, "tid": "2", "begin": "40000", "end": "60000"}))
    assert total == reads.count() and 0 < some < total / 8
    assert read(bam.BamReader({"path": path, "tid": "2", "begin": "900000", "end": "1000000"})) == 0


def test_filters_reach_the_scan(spark, indexed):
    reads, _, path = indexed
    condition = "tid = 2 AND pos >= 40000 AND pos < 60000"
    rows = spark.read.format("bam").load(path).where(condition)
    assert sorted(r.qname for r in rows.collect()) == sorted(r.qname for r in reads.where(condition).collect())
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    reader = bam.BamReader({"path": path})
    given = [EqualTo(("tid",), 2), GreaterThanOrEqual(("pos",), 40000), LessThan(("pos",), 60000)]
    assert list(reader.pushFilters(given)) == given  # Spark still filters the rows
    assert (reader.asked.tid, reader.asked.least, reader.asked.most) == (2, 40000, 59999)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) < reads.count() / 8
    assert spark.read.format("bam").load(path).where("pos < 0 OR tid = 1").count() == reads.where("tid = 1").count()


def test_a_stale_index_is_refused(spark, indexed, tmp_path):
    import shutil

    copy = tmp_path / "b"
    shutil.copytree(indexed[2], copy)
    first = next(f for f in os.listdir(copy) if f.endswith(".bam"))
    shutil.copy(copy / first, copy / "z.bam")
    with pytest.raises(ValueError, match="write_index"):
        bam.BamReader({"path": str(copy), "tid": "2"}).partitions()


def test_layout_prunes_partitions_and_places(spark, indexed, tmp_path):
    reads, contigs, _ = indexed
    path = str(tmp_path / "l")
    lines.write_layout(reads, path)
    regions = ["ASIA:40000-60000", "EUROPE:100000", "MIDDLE_EAST", "NOWHERE", "*", "ASIA:50000-50000"]
    assert names(lines.read_layout(spark, path, contigs, regions)) == names(filters.view_regions(reads, contigs, regions))
    plan = lines.read_layout(spark, path, contigs, ["ASIA:40000-60000"])._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "PartitionFilters" in x and "contig" in x)
    assert "(contig#" in scan and "= 2)" in scan
    assert "LessThanOrEqual(pos,60000)" in scan and "GreaterThanOrEqual(pos,39" in scan

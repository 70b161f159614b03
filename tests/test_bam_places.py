"""A region's scan gives only records that overlap it; the index says what the records say; tags start from none."""

from pyspark.sql import functions as F

from readloom.functions.cigar import end_position
from readloom.functions.tags import with_tags
from readloom.sources import bam
from tests.test_bam_ranges import indexed  # noqa: F401


def given(options):
    reader = bam.BamReader(options)
    return sorted((r["qname"], r["flag"], r["pos"]) for t in reader.partitions() for b in reader.read(t) for r in b.to_pylist())


def test_records_beside_the_region_are_not_decoded(indexed):  # noqa: F811
    reads, _, path = indexed
    for begin, end in ((40_000, 60_000), (50_000, 50_100), (1, 2**31 - 1), (900_000, 1_000_000)):
        rows = reads.where((F.col("tid") == 2) & (F.col("pos") <= end) & (end_position() >= begin))
        want = sorted((r.qname, r.flag, r.pos) for r in rows.select("qname", "flag", "pos").collect())
        assert given({"path": path, "tid": "2", "begin": str(begin), "end": str(end), "columns": "qname,flag,pos"}) == want


def test_filters_leave_out_records_before_they_are_decoded(indexed):  # noqa: F811
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    reads, _, path = indexed
    for filters, condition in (([EqualTo(("tid",), 2), GreaterThan(("pos",), 40_000), LessThanOrEqual(("pos",), 41_000)], "tid = 2 and pos > 40000 and pos <= 41000"), ([EqualTo(("tid",), 3)], "tid = 3"), ([EqualTo(("tid",), 3), LessThanOrEqual(("pos",), -1)], "tid = 3 and pos <= -1")):
        reader = bam.BamReader({"path": path, "columns": "qname"})
        assert list(reader.pushFilters(filters)) == filters
        got = sorted(x for t in reader.partitions() for b in reader.read(t) for x in b["qname"].to_pylist())
        assert got == sorted(r.qname for r in reads.where(condition).select("qname").collect())


def test_the_index_says_what_the_records_say(spark, indexed):  # noqa: F811
    path = indexed[2]
    sizes = [size for _, size in bam._listed(path)]
    want = {}
    for r in spark.read.format("bam").load(path).where("tid is not null and pos is not null").withColumn("reach", end_position()).collect():
        file, base = max((k, sum(sizes[:k])) for k in range(len(sizes)) if sum(sizes[:k]) <= r.ord >> 16)
        own = r.ord - (base << 16)
        first, last, reach, n = want.get((file, r.tid, (r.pos - 1) >> 14), (own, own, 0, 0))
        want[file, r.tid, (r.pos - 1) >> 14] = (min(first, own), max(last, own), max(reach, r.reach), n + 1)
    rows = spark.read.parquet(f"{path}/{bam.INDEX}").collect()
    assert len(want) > 50 and {(r.file, r.tid, r.bin): (r["first"], r["last"], r.reach, r.n) for r in rows} == want
    assert {r.bytes for r in rows} == {sum(sizes)}


def test_read_regions_gives_the_columns_that_are_asked_for(spark, indexed):  # noqa: F811
    _, contigs, path = indexed
    regions = ["ASIA:40,000-60000", "NOWHERE"]
    some = bam.read_regions(spark, path, contigs, regions, columns="tid,pos,cigar,rg")
    assert some.columns == ["tid", "pos", "cigar", "rg", "region"]
    whole = bam.read_regions(spark, path, contigs, regions)
    assert sorted(map(repr, some.collect())) == sorted(map(repr, whole.select(*some.columns).collect()))


def test_tags_of_rows_without_any(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    tags = {"NM": ("i", F.col("k")), "XZ": ("Z", F.col("v"))}
    none = rows.withColumn("tags", F.lit(None).cast("map<string,struct<type:string,value:string>>"))
    got, want = with_tags(rows, tags), with_tags(none, tags)
    assert got.schema["tags"].dataType == want.schema["tags"].dataType
    assert [r.asDict(True) for r in got.orderBy("k").select("k", "tags").collect()] == [r.asDict(True) for r in want.orderBy("k").select("k", "tags").collect()]

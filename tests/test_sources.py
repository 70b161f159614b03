"""Formats: round trips, cut files, odd lines; reports; streams."""

import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from readloom.fixtures import relation
from readloom.functions.tags import tag, with_tags
from readloom.operators import counts
from readloom.plans import render
from readloom.schema import READS
from readloom.sources import bam, lines
from readloom.streaming.counts import stream_contig_counts, stream_flagstat


NAMES = [f.name for f in READS if f.name not in ("ord", "tags")]


def rows_of(df):
    rows = df.select(*NAMES, F.to_json("tags").alias("t")).fillna(-9).fillna("?")
    return sorted((*r[:-1], *sorted(json.loads(r.t).items(), key=repr)) for r in rows.collect())


def tagged(reads):
    """reads with a tag of each kind, and their own RG and RX."""
    extra = {"NM": ("i", F.col("ord") % 9 - 4), "XI": ("i", F.lit(4_000_000_000)), "XA": ("A", F.substring("rx", 1, 1)), "XZ": ("Z", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("a:b c"), "qname")))}
    extra |= {"XF": ("f", F.when(F.col("ord") % 2 == 0, F.lit("0.25"))), "XB": ("B", F.concat(F.lit("S,7,"), F.col("ord") % 100)), "XH": ("H", F.lit("1AE3")), "RG": ("Z", F.col("rg")), "RX": ("Z", F.col("rx"))}
    return with_tags(reads, extra)


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return tagged(relation(spark, sf_dir, "reads")).cache(), relation(spark, sf_dir, "contigs").selectExpr("cast(tid as int) tid", "name", "cast(length as int) length")


def test_sam_round_trip(spark, tables, tmp_path):
    reads, contigs = tables
    lines.write_sam(reads, contigs, str(tmp_path / "x"))
    back = lines.read_sam(spark, str(tmp_path / "x"))
    assert rows_of(back) == rows_of(reads)
    assert [r.qname for r in back.orderBy("ord").collect()] == [r.qname for r in reads.orderBy("ord").collect()]
    assert sorted(map(tuple, lines.sam_header(spark, str(tmp_path / "x"))["contigs"].collect())) == sorted(map(tuple, contigs.collect()))


@pytest.mark.parametrize("split", [3000, 1 << 26])
def test_bam_round_trip(spark, tables, tmp_path, split):
    reads, contigs = tables
    bam.register(spark)
    reads.select(*[f.name for f in READS]).coalesce(2).write.format("bam").option("contigs", bam.contig_option(contigs)).mode("append").save(str(tmp_path / "b"))
    back = spark.read.format("bam").option("split", split).load(str(tmp_path / "b"))
    assert rows_of(back) == rows_of(reads)
    assert back.select("ord").distinct().count() == reads.count()
    files = sorted(f for f in os.listdir(tmp_path / "b") if f.endswith(".bam"))
    first = str(tmp_path / "b" / files[0])
    assert bam.quickcheck(first) is None and bam.detect_format(first) == "bam"
    cut = tmp_path / "cut.bam"
    cut.write_bytes(open(first, "rb").read()[:-28])
    assert bam.quickcheck(str(cut)) == "no end marker"
    found = {r.path: r.problem for r in bam.quickcheck_files(spark, [first, str(cut)]).collect()}
    assert found == {first: None, str(cut): "no end marker"}
    text = tmp_path / "t.sam"
    text.write_text("@HD\n")
    assert bam.quickcheck(str(text)) and bam.quickcheck(str(text), unrecognized_ok=True) is None


def test_names_and_headers_survive(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "HLA-A*01:01,x", 3503), (1, "é", 7)], "tid int, name string, length int")
    rows = [(0, "q", 0, 1, 5, 9, "1M", None, None, 0, "A", "I", "g1", None, {"XZ": ("Z", "t")})]
    reads = spark.createDataFrame(rows, READS)
    reads.write.format("bam").option("contigs", bam.contig_option(contigs)).mode("append").save(str(tmp_path / "b"))
    reads.write.format("bam").option("contigs", bam.contig_option(contigs)).mode("append").save(str(tmp_path / "b"))
    files = [str(tmp_path / "b" / f) for f in os.listdir(tmp_path / "b") if f.endswith(".bam")]
    assert len(files) >= 2 and bam.read_header(files[0])[1] == [("HLA-A*01:01,x", 3503), ("é", 7)]
    assert spark.read.format("bam").load(f"file://{tmp_path}/b").where("tid = 1 and pos = 5").count() == 2
    groups = spark.createDataFrame([("g1", "s", None), ("g2", None, "lib")], "id string, sm string, lb string")
    programs = spark.createDataFrame([("p", "n", None, "c d", None), ("p-1", "n", "1", None, "p")], "id string, pn string, vn string, cl string, pp string")
    notes = spark.createDataFrame([("a\tb",), ("",)], "comment string")
    lines.write_sam(reads, contigs, str(tmp_path / "s"), order="coordinate", read_groups=groups, programs=programs, comments=notes)
    head = lines.sam_header(spark, str(tmp_path / "s"))
    assert [tuple(r) for r in head["read_groups"].select("id", "sm", "lb").collect()] == [tuple(r) for r in groups.collect()]
    assert [tuple(r) for r in head["programs"].collect()] == [tuple(r) for r in programs.collect()]
    assert [r.comment for r in head["comments"].collect()] == ["a\tb", ""]
    assert lines.read_sam(spark, str(tmp_path / "s")).select(tag("XZ"), "rg").first() == ("t", "g1")


def test_a_tag_that_repeats_counts_once(spark, tmp_path):
    (tmp_path / "x.sam").write_text("q\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\tXA:Z:1\tXA:Z:2\tbad\tXB:Z:\n")
    contigs = spark.createDataFrame([], "tid int, name string, length int")
    row = lines.read_sam(spark, str(tmp_path / "x.sam"), contigs).first()
    assert {k: tuple(v) for k, v in row.tags.items()} == {"XA": ("Z", "1"), "XB": ("Z", "")}


def test_indexes(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\n>three x\nGGG\nTT\n")
    got = [tuple(r) for r in lines.fasta_index(spark, str(tmp_path / "a.fa")).orderBy("tid").collect()]
    assert got == [(0, "one", 6, 11, 4, 5), (1, "two", 0, 24, 0, 0), (2, "three", 5, 33, 3, 4)]
    (tmp_path / "a.fq").write_text("@x 1\nAC\n+\nII\n@y\nGTT\n+y\nIII\n@cut\nA\n")
    got = [tuple(r) for r in lines.fastq_index(spark, str(tmp_path / "a.fq")).orderBy("n").collect()]
    assert got == [(0, "x", 2, 5, 10), (1, "y", 3, 16, 23)]
    chunks = lines.fasta_chunks(spark, str(tmp_path / "a.fa"), lines=1).orderBy("tid", "chunk").collect()
    assert [(r.tid, r.chunk, r.text) for r in chunks] == [(0, 0, "ACGT"), (0, 1, "AC"), (2, 0, "GGG"), (2, 1, "TT")]


def test_fasta_fastq_bed(spark, tables, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n\n>two\n>three x\nGG\nTT\nA\n")
    assert [tuple(r) for r in lines.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("tid").collect()] == [(0, "one", "ACGTAC"), (1, "two", ""), (2, "three", "GGTTA")]
    (tmp_path / "a.fq").write_text("@x 1\nAC\n+\nII\n@y\nG\n+\nI\n@cut\nA\n")
    assert [tuple(r) for r in lines.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("n").collect()] == [(0, "@x 1", "AC", "II"), (1, "@y", "G", "I")]
    (tmp_path / "a.bed").write_text("#c\ntrack x\nASIA\t1\t5\tamp\n\nASIA\tx\t9\nno\t1\nMARS\t3\t4\n")
    got = [tuple(r)[1:] for r in lines.read_bed(spark, str(tmp_path / "a.bed"), tables[1]).orderBy("iv").collect()]
    assert got == [(2, "amp", 1, 5), (2, None, 0, 9), (None, None, 3, 4)]


def test_split_and_layout(spark, tables, tmp_path):
    reads, _ = tables
    lines.write_split(reads, str(tmp_path / "s"))
    assert sorted(os.path.basename(p) for p in os.listdir(tmp_path / "s") if p.startswith("value")) == ["value=rg0", "value=rg1", "value=rg2", "value=unknown"]
    lines.write_layout(reads, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).where("contig = 2 AND pos BETWEEN 10 AND 90").count() == reads.where("tid = 2 AND pos BETWEEN 10 AND 90").count()


def test_reports(spark, tables):
    result = counts.flagstat(tables[0])
    text = render.flagstat_text(result)
    assert text.count("\n") == 16 and "%" in text
    assert json.loads(render.flagstat_json(result))["QC-passed reads"]["total"] > 0
    assert render.percent(1, 0) == "N/A" and render.percent(1, 8) == "12.50%"
    assert render.table(spark.createDataFrame([("a", 0.5)], "n string, v double")) == "#n\t#v\na\t0.5000\n"


def test_streams(spark, tables, tmp_path):
    reads, _ = tables
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, f in (("fs", stream_flagstat), ("cc", stream_contig_counts)):
        stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = f(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(map(tuple, spark.table("fs").collect())) == sorted(map(tuple, counts.flagstat(reads).collect()))
    assert spark.table("cc").count() == 5


def test_bad_lines(spark, tmp_path):
    good = "q\t0\tc\t5\t9\t4M\t*\t0\t0\tACGT\tIIII"
    spoilt = [("fields", "q\t0\tc"), ("flag", good.replace("\t0\tc", "\tx\tc")), ("flag", good.replace("\t0\tc", "\t70000\tc")), ("pos", good.replace("\t5\t", "\t-1\t")), ("mapq", good.replace("\t9\t", "\t\t"))]
    spoilt += [("cigar", good.replace("4M", "M4")), ("cigar length", good.replace("4M", "5M")), ("qual length", good[:-1]), ("reference", good.replace("\tc\t", "\td\t")), ("tlen", good.replace("\t0\tACGT", "\t9999999999\tACGT"))]
    (tmp_path / "x.sam").write_text("\n".join(["@SQ\tSN:c\tLN:99", good, *[x for _, x in spoilt], "", good]) + "\n")
    path = str(tmp_path / "x.sam")
    kept = lines.read_sam(spark, path, bad="keep").orderBy("ord").collect()
    assert [(r.reason, r.corrupt) for r in kept] == [(None, None), *spoilt, (None, None)]
    assert all(r.qname is None and r.tags is None for r in kept[1:-1]) and kept[0].seq == "ACGT" and kept[0].ord == 1
    seen = Observation("sam")
    assert lines.read_sam(spark, path, bad="drop", observation=seen).count() == 2
    assert seen.get == {"good": 2, "bad": len(spoilt)}
    with pytest.raises(Exception, match=r"bad SAM line 2 \(fields\)"):
        lines.read_sam(spark, path).collect()
    with pytest.raises(ValueError):
        lines.read_sam(spark, path, bad="ignore")


def test_clear_by_label_and_age(spark, tmp_path, monkeypatch):
    from readloom import session

    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}")
    assert session.clear(spark) == 0
    a, b = (session.stash(spark.range(3), x) for x in ("some-table", "other"))
    assert session.clear(spark) == 0 and a.count() == 3
    assert session.clear(spark, label="table", older_than=-1) == 0
    assert session.clear(spark, label="some-table", older_than=-1) == 1 and b.count() == 3
    assert session.clear(spark, older_than=-1) == 1 and not os.listdir(tmp_path / "readloom")

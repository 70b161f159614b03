"""Random access by indexes, dictionaries of chunks, split outputs."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from readloom.fixtures import relation
from readloom.operators import sequences
from readloom.schema import READS
from readloom.sources import access, bam, lines


def test_fasta_slices_read_their_bytes_only(spark, tmp_path):
    rng = random.Random(2)
    names = {f"s{k}": "".join(rng.choices("ACGTN", k=n)) for k, n in enumerate([0, 1, 59, 60, 61, 5000, 200_000])}
    path = tmp_path / "f"
    path.mkdir()
    (path / "_SUCCESS").write_text("")
    for k, chunk in enumerate([["s0", "s1", "s2"], [], ["s3", "s4", "s5"], ["s6"]]):
        (path / f"part-{k}.txt").write_text("".join(f">{n} text\n" + "".join(names[n][a : a + 60] + "\n" for a in range(0, len(names[n]), 60)) for n in chunk))
    asked = [(n, a, b) for n in names for a, b in [(1, 10), (-5, 3), (0, 0), (60, 61), (61, 60), (1000, 9_000_000)]] + [("s6", 150_000, 150_100), ("none", 1, 2)]
    regions = spark.createDataFrame(asked, "name string, start long, end long")
    got = access.fasta_slices(str(path), lines.fasta_index(spark, str(path)), regions).collect()
    want = sorted((n, a, b, names[n][max(a, 1) - 1 : max(b, 0)] if b >= a else "") for n, a, b in asked if n in names)
    assert sorted((r.name, r.start, r.end, r.sequence) for r in got) == want
    small = next(r for r in got if (r.name, r.start) == ("s6", 150_000))
    assert small.bytes_read <= 103
    assert all(r.bytes_read <= len(r.sequence) + len(r.sequence) // 60 + 1 for r in got)


def test_fastq_records(spark, tmp_path):
    path = tmp_path / "f"
    path.mkdir()
    records = [(f"n{k % 900}", "ACGT" * (1 + k % 5), "I" * 4 * (1 + k % 5)) for k in range(1000)]
    for p in range(3):
        (path / f"part-{p}.txt").write_text("".join(f"@{n} c\n{s}\n+\n{q}\n" for n, s, q in records[p * 400 : p * 400 + 400]))
    names = spark.createDataFrame([("n0",), ("n7",), ("n7",), ("n899",), ("none",)], "name string")
    got = access.fastq_records(str(path), lines.fastq_index(spark, str(path)), names).collect()
    last = {n: (s, q) for n, s, q in records}
    assert {r.name: (r.seq, r.qual) for r in got} == {n: last[n] for n in ("n0", "n7", "n899")}
    assert sum(r.bytes_read for r in got) == sum(len(r.seq) + len(r.qual) for r in got)


def test_digest_is_carried_over_chunks(spark):
    rng = random.Random(3)
    texts = {k: "".join(rng.choices("acgtACGTN", k=n)) for k, n in enumerate([5, 0, 3000, 1])}
    chunks = [(k, f"c{k}", c, t[c * 7 : c * 7 + 7]) for k, t in texts.items() for c in range(max(1, -(-len(t) // 7)))]
    rng.shuffle(chunks)
    got = sequences.chunk_digests(spark.createDataFrame(chunks, "tid int, name string, chunk long, text string").repartition(5)).collect()
    assert {r.tid: (r.name, r.length, r.md5) for r in got} == {k: (f"c{k}", len(t), hashlib.md5(t.upper().encode()).hexdigest()) for k, t in texts.items()}
    out = sequences.dictionary_lines(sequences.chunk_digests(spark.createDataFrame([], "tid int, name string, chunk long, text string"))).collect()
    assert [r.line for r in out] == ["@HD\tVN:1.6\tSO:unsorted"]


def test_split_files_have_headers_and_names(spark, sf_dir, tmp_path):
    reads = relation(spark, sf_dir, "reads").withColumn("rg", F.when(F.col("ord") % 9 == 0, "../a/b").otherwise(F.col("rg"))).withColumn("tags", F.lit(None))
    contigs = relation(spark, sf_dir, "contigs")
    bam.write_split(reads, str(tmp_path / "s"), contigs, pattern="%*-%!.bam", stem="x")
    folders = bam.split_folders(str(tmp_path / "s"))
    assert [os.path.basename(f) for f in folders] == ["x-.._a_b.bam", "x-rg0.bam", "x-rg1.bam", "x-rg2.bam", "x-unknown.bam"]
    assert not [f for f in os.listdir(tmp_path / "s") if f.startswith(".part")]
    total = 0
    for folder in folders:
        for f in os.listdir(folder):
            assert bam.quickcheck(f"{folder}/{f}") is None and len(bam.read_header(f"{folder}/{f}")[1]) == 5
        back = spark.read.format("bam").load(folder)
        total += back.count()
        assert back.select("rg").distinct().count() == 1
    assert total == reads.count() and READS

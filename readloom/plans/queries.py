"""Registered queries over the derived relations: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from readloom.fixtures import relation
from readloom.functions.cigar import end_position, has, mapped, placed, primary
from readloom.functions.cigar import base_quality_sum as quality_sum
from readloom.functions.cigar import unclipped_5_prime
from readloom.functions.tags import tag, to_fields, with_tags
from readloom.operators import counts, depth, duplicates, filters, headers, intervals, mates, ordering, pileup, sequences
from readloom.plans import render
from readloom.schema import READS
from readloom.session import new_path, stash
from readloom.sources import access, bam, lines, merging

QUERIES = {}
#: Integer columns that may be missing; results show -1 there, so that all engines keep them integers.
MISSING = ("tid", "pos", "mapq", "mtid", "mpos", "ms", "nm")


def query(f):
    @functools.wraps(f)
    def shown(spark, sf_dir):
        out = f(spark, sf_dir)
        return out.withColumns({c: F.coalesce(c, F.lit(-1).cast(out.schema[c].dataType)) for c in out.columns if c in MISSING})

    QUERIES[f.__name__] = shown
    return shown


def _get(spark, sf_dir, *names):
    out = tuple(relation(spark, sf_dir, n) for n in names)
    return out if len(out) > 1 else out[0]


def _halves(reads):
    """Two inputs, by parity of the template number."""
    return [reads.where(f"(ord div 4) % 2 = {k}") for k in (0, 1)]


SHOWN = ["ord", "qname", "flag", "tid", "pos", "mapq", "cigar"]
FIELDS = [f.name for f in READS if f.name not in ("ord", "tags")]


def _tagged(spark, sf_dir, *order):
    """The reads, in an order if one is given, with tags made from their columns."""
    reads = _get(spark, sf_dir, "reads")
    tags = {"NM": ("i", F.col("mapq")), "XZ": ("Z", F.when(F.col("cigar") != "", F.col("cigar"))), "XA": ("A", F.substring("rx", 1, 1))}
    if order:
        # A sort looks at its input twice, and the bases are costly to derive.
        reads = stash(reads, "reads").orderBy(*order)
    return with_tags(reads, tags)


def _shown(rows):
    return rows.select(*FIELDS, tag("NM").cast("int").alias("nm"), tag("XZ").alias("xz"), tag("XA").alias("xa"))


def _written_bam(spark, sf_dir):
    """The reads, written as BAM files; and the path."""
    contigs, path = _get(spark, sf_dir, "contigs"), new_path(spark, "bam")
    bam.register(spark)
    rows = _tagged(spark, sf_dir).select(*[F.col(f.name).cast(f.dataType) for f in READS])
    rows.write.format("bam").option("contigs", bam.contig_option(contigs)).mode("append").save(path)
    return rows, path


def _bam_file(spark, sf_dir):
    """The reads, written as BAM files and read back."""
    return spark.read.format("bam").load(_written_bam(spark, sf_dir)[1])


def _sam_file(spark, sf_dir):
    """The reads, written as SAM text and read back; and the path."""
    contigs, path = _get(spark, sf_dir, "contigs"), new_path(spark, "sam")
    groups = spark.createDataFrame([("rg0", "s"), ("rg1", None)], "id string, sm string")
    lines.write_sam(_tagged(spark, sf_dir), contigs, path, read_groups=groups)
    return lines.read_sam(spark, path), path


@query
def bam_file(spark, sf_dir):
    return _shown(_bam_file(spark, sf_dir))


@query
def quickcheck(spark, sf_dir):
    """What the written BAM files lack: nothing."""
    _, path = _written_bam(spark, sf_dir)
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("path").collect()]
    return bam.quickcheck_files(spark, files).select(F.coalesce("problem", F.lit("ok")).alias("state")).distinct()


@query
def sam_file(spark, sf_dir):
    return _shown(_sam_file(spark, sf_dir)[0])


def _spoilt_sam(spark, sf_dir):
    """SAM text of all reads in which that of every seventh template is spoilt in one of seven ways; the path."""
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    path = new_path(spark, "sam")
    f, way = F.split("value", "\t", -1), F.when(F.floor(F.col("ord") / 4) % 7 == 0, F.floor(F.col("ord") / 28) % 7)

    def put(k, text):
        return F.array_join(F.transform(f, lambda x, i: F.when(i == k, F.lit(text)).otherwise(x)), "\t")

    ways = [F.array_join(F.slice(f, 1, 9), "\t"), put(1, "0x1"), put(3, "1e3"), put(4, "300"), put(5, "4Q"), put(10, "I"), put(2, "chrZ")]
    value = F.col("value")
    for k, x in enumerate(ways):
        value = F.when(way == k, x).otherwise(value)
    rows = lines.sam_lines(reads, contigs).select(F.lit(9).alias("section"), F.col("ord").alias("n"), value.alias("value"))
    lines.header_lines(contigs).unionByName(rows).orderBy("section", "n").select("value").write.text(path)
    return path


@query
def sam_bad_lines(spark, sf_dir):
    """What is wrong with the bad lines of a file, counted by reason; good lines under "ok"."""
    rows = lines.read_sam(spark, _spoilt_sam(spark, sf_dir), bad="keep")
    return rows.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.count("corrupt").alias("lines"))


@query
def sam_without_bad_lines(spark, sf_dir):
    return lines.read_sam(spark, _spoilt_sam(spark, sf_dir), bad="drop").select(*FIELDS)


@query
def sam_header(spark, sf_dir):
    return lines.sam_header(spark, _sam_file(spark, sf_dir)[1])["contigs"]


@query
def flagstat_file(spark, sf_dir):
    return counts.flagstat(_bam_file(spark, sf_dir))


@query
def view_file(spark, sf_dir):
    return filters.view(_bam_file(spark, sf_dir), require=0x1, exclude=0xF04, min_mapq=20).select(*FIELDS)


LONG_FILE = 32 << 20  # bases of a file of long reads
DIGITS = bytes.maketrans(b"0123456789abcdef", b"ACGTACGTACGTACGT")


@F.arrow_udf(StringType())
def digits_to_bases(digits: pa.Array) -> pa.Array:
    """translate() of hex digits; Spark's own looks up each character in a map (80 ns), this is one pass over the bytes."""
    valid, offsets, values = digits.buffers()
    return pa.Array.from_buffers(digits.type, len(digits), [valid, offsets, pa.py_buffer(values.to_pybytes().translate(DIGITS) if values else b"")], offset=digits.offset)


@query
def bam_long_reads(spark, sf_dir):
    """Reads of many blocks each, one per supplier, written as BAM and read in ranges that are shorter than a read."""
    contigs, path = _get(spark, sf_dir, "contigs"), new_path(spark, "bam")
    bam.register(spark)
    # Rows that repeat a key say each piece as often. Pieces are made where the read is written: no shuffle sees them.
    reads = _get(spark, sf_dir, "long_reads").where("pieces > 0").groupBy("k", "qname", "tid", "pos", "pieces").agg(F.count("*").cast("int").alias("times"))
    size = reads.agg(F.coalesce(F.sum(32 * F.col("pieces") * F.col("times")), F.lit(0))).first()[0]
    files = max(4, -(-size // LONG_FILE))
    k = F.concat(F.col("k").cast("string"), F.lit("/"))
    piece = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: F.repeat(F.md5(F.concat(k, i.cast("string"))), F.col("times")))
    rows = reads.repartition(files, "k").sortWithinPartitions("k").withColumn("seq", digits_to_bases(F.array_join(piece, ""))).withColumns({"flag": F.lit(0), "mapq": F.lit(60), "tlen": F.lit(0), "cigar": F.concat(F.length("seq").cast("string"), F.lit("M"))})
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in READS]
    rows.select(*columns).write.format("bam").option("contigs", bam.contig_option(contigs)).mode("append").save(path)
    back = spark.read.format("bam").options(split=30_000, columns="qname,flag,tid,pos,mapq,cigar,seq").load(path)
    return back.select("qname", "flag", "tid", "pos", "mapq", "cigar", F.length("seq").alias("bases"), F.md5("seq").alias("digest"))


def _sorted_bam(spark, sf_dir):
    """The reads in order of place, written as indexed BAM files; the contigs and the path."""
    contigs, path = _get(spark, sf_dir, "contigs"), new_path(spark, "bam")
    bam.register(spark)
    # Tags follow from the other columns: they are made behind the sort.
    rows = _tagged(spark, sf_dir, *ordering.coordinate_keys()).select(*[F.col(f.name).cast(f.dataType) for f in READS])
    rows.write.format("bam").option("contigs", bam.contig_option(contigs)).mode("append").save(path)
    bam.write_index(spark, path)
    return contigs, path


@query
def view_bam_regions(spark, sf_dir):
    """Regions of indexed BAM files: only the ranges that may hold some of their reads are read."""
    contigs, path = _sorted_bam(spark, sf_dir)
    return bam.read_regions(spark, path, contigs, ["ASIA:200-700", "EUROPE:1000", "MIDDLE_EAST", "NOWHERE"], columns=",".join(FIELDS)).select("region", *FIELDS)


@query
def view_bam_filter(spark, sf_dir):
    """A plain filter on contig and place reaches the scan of indexed BAM files."""
    return spark.read.format("bam").load(_sorted_bam(spark, sf_dir)[1]).where("tid = 2 AND pos BETWEEN 200 AND 700").select(*FIELDS)


@query
def view_layout(spark, sf_dir):
    """Regions of the Parquet layout, by partition, place and the longest span of the contig."""
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    path = new_path(spark, "layout")
    lines.write_layout(reads, path)
    return lines.read_layout(spark, path, contigs, ["ASIA:200-700", "ASIA:500-900", "EUROPE:1000", "MIDDLE_EAST", "*"]).select("region", *SHOWN)


@query
def split_files(spark, sf_dir):
    path = new_path(spark, "split")
    lines.write_split(_tagged(spark, sf_dir), path, tag="XZ")
    return spark.read.parquet(path).groupBy("value").agg(F.count("*").alias("n"))


def _fasta_path(spark, sf_dir):
    path = new_path(spark, "fasta")
    lines.write_fasta(_get(spark, sf_dir, "transcripts"), path, width=60)
    return path


@query
def split_bam_files(spark, sf_dir):
    """What is in the BAM files of each read group, read back from the folders that a pattern names."""
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    path, out = new_path(spark, "split"), None
    bam.write_split(_tagged(spark, sf_dir), path, contigs, tag="RG", pattern="%*.%!.bam", stem="all")
    for folder in bam.split_folders(path):
        part = spark.read.format("bam").load(folder).select(F.lit(folder.rpartition("/")[2]).alias("name"), "qname", "flag", F.xxhash64("seq").alias("h"), F.coalesce("rg", F.lit("unknown")).alias("rg"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("name").agg(F.count("*").alias("n"), F.sum("flag").alias("flags"), F.min("qname").alias("low"), F.max("qname").alias("high"), F.min("rg").alias("rg"), F.count_distinct("rg").alias("groups"))


@query
def dict_chunks(spark, sf_dir):
    """The dictionary of a FASTA file whose sequences are read in chunks of three lines."""
    chunks = lines.fasta_chunks(spark, _fasta_path(spark, sf_dir), lines=3)
    return sequences.dictionary_lines(sequences.chunk_digests(chunks), assembly="asm")


@query
def faidx_file(spark, sf_dir):
    """Slices of a FASTA file by its index: only their bytes are read."""
    path = _fasta_path(spark, sf_dir)
    rows, start = _get(spark, sf_dir, "transcripts"), F.col("tid") % 60
    regions = rows.select("name", start.alias("start"), (start + 3 * F.col("size")).alias("end"))
    return access.fasta_slices(path, lines.fasta_index(spark, path), regions).drop("bytes_read")


@query
def fqidx_file(spark, sf_dir):
    """Records of a FASTQ file by its index: only their bytes are read."""
    path = f"{_fastq_path(spark, sf_dir)}/sink=r1"
    index = stash(lines.fastq_index(spark, path), "fqi")
    return access.fastq_records(path, index, index.where("n % 5 = 0").select("name")).drop("bytes_read")


@query
def merge_programs(spark, sf_dir):
    """The programs of three inputs, each a chain of one per nation under the same ids."""
    nation, p = spark.read.parquet(f"{sf_dir}/nation.parquet"), F.concat(F.lit("p"), F.col("n_nationkey").cast("string"))
    before = F.when(F.col("n_nationkey") > 0, F.concat(F.lit("p"), (F.col("n_nationkey") - 1).cast("string")))
    tables = [nation.select(p.alias("id"), F.concat_ws("-", "n_name", F.lit(str(k))).alias("pn"), before.alias("pp")) for k in range(3)]
    return headers.merge_programs(tables)


@query
def fasta_file(spark, sf_dir):
    return lines.read_fasta(spark, _fasta_path(spark, sf_dir))


@query
def fai_file(spark, sf_dir):
    return lines.fasta_index(spark, _fasta_path(spark, sf_dir))


def _fastq_path(spark, sf_dir):
    path = new_path(spark, "fastq")
    lines.write_fastq(mates.fastq(_get(spark, sf_dir, "reads"), suffix=True), path)
    return path


@query
def fastq_files(spark, sf_dir):
    """The records of all sinks, each a folder of text files."""
    path, out = _fastq_path(spark, sf_dir), None
    for sink in ("r1", "r2", "singleton"):
        part = lines.read_fastq(spark, f"{path}/sink={sink}").select(F.lit(sink).alias("sink"), "header", "seq", "qual")
        out = part if out is None else out.unionByName(part)
    return out


@query
def fqi_file(spark, sf_dir):
    return lines.fastq_index(spark, f"{_fastq_path(spark, sf_dir)}/sink=r1")


@query
def bed_file(spark, sf_dir):
    bed, contigs = _get(spark, sf_dir, "bed", "contigs")
    path = new_path(spark, "bed")
    lines.write_bed(bed, contigs, path)
    return lines.read_bed(spark, path, contigs).select("iv", F.col("tid").cast("int").alias("tid"), "name", "bstart", "bend")


@query
def idxstats_report(spark, sf_dir):
    return render.idxstats_lines(*_get(spark, sf_dir, "reads", "contigs"))


@query
def stats_report(spark, sf_dir):
    return render.stats_lines(_get(spark, sf_dir, "reads"))


@query
def markdup_report(spark, sf_dir):
    return render.markdup_lines(_get(spark, sf_dir, "reads"))


@query
def flagstat(spark, sf_dir):
    return counts.flagstat(_get(spark, sf_dir, "reads"))


@query
def flagstat_percent(spark, sf_dir):
    rows = counts.flagstat(_get(spark, sf_dir, "reads"))
    wide = rows.groupBy().pivot("metric", ["total", "primary", "mapped", "primary mapped", "paired in sequencing", "properly paired", "singletons"]).agg(F.first("qc_pass"))
    pairs = {"mapped_percent": ("mapped", "total"), "primary_mapped_percent": ("primary mapped", "primary"), "properly_paired_percent": ("properly paired", "paired in sequencing"), "singletons_percent": ("singletons", "paired in sequencing")}
    return wide.select(*[F.when(F.col(f"`{d}`") > 0, F.lit(100.0) * F.col(f"`{n}`") / F.col(f"`{d}`")).alias(a) for a, (n, d) in pairs.items()])


@query
def idxstats(spark, sf_dir):
    return counts.idxstats(*_get(spark, sf_dir, "reads", "contigs"))


@query
def view_require(spark, sf_dir):
    return filters.view(_get(spark, sf_dir, "reads"), require=0x3).select(*SHOWN)


@query
def view_exclude(spark, sf_dir):
    return filters.view(_get(spark, sf_dir, "reads"), exclude=0xF04).select(*SHOWN)


@query
def view_mapq(spark, sf_dir):
    return filters.view(_get(spark, sf_dir, "reads"), min_mapq=30).select(*SHOWN)


@query
def view_region(spark, sf_dir):
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    return filters.view_regions(reads, contigs, ["ASIA:200-700"], exclude=4).select(*SHOWN)


@query
def view_multi_region(spark, sf_dir):
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    return filters.view_regions(reads, contigs, ["ASIA:200-700", "ASIA:500-900", "EUROPE:1000", "MIDDLE_EAST", "*"]).select("region", *SHOWN)


@query
def view_exclude_region(spark, sf_dir):
    return filters.view(_get(spark, sf_dir, "reads"), drop_regions=["ASIA:200-1200"]).select(*SHOWN)


@query
def view_count(spark, sf_dir):
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    return filters.view_regions(reads, contigs, ["ASIA:200-700", "ASIA:500-900"], min_mapq=10).agg(F.count("*").alias("n"))


@query
def stats_summary(spark, sf_dir):
    return counts.stats_summary(_get(spark, sf_dir, "reads"), min_mapq=5)


@query
def stats_target_bed(spark, sf_dir):
    reads, bed = _get(spark, sf_dir, "reads", "bed")
    return counts.stats_summary(reads, targets=bed)


@query
def stats_read_length(spark, sf_dir):
    return counts.read_lengths(_get(spark, sf_dir, "reads"))


@query
def stats_insert_size(spark, sf_dir):
    return counts.insert_sizes(_get(spark, sf_dir, "reads"))


@query
def stats_gc(spark, sf_dir):
    return counts.gc_content(_get(spark, sf_dir, "reads"))


@query
def stats_mapq(spark, sf_dir):
    return counts.mapping_qualities(_get(spark, sf_dir, "reads"))


@query
def index_bins(spark, sf_dir):
    return counts.index_bins(_get(spark, sf_dir, "reads"), min_shift=8, depth=5)


@query
def split_counts(spark, sf_dir):
    return counts.split_counts(_get(spark, sf_dir, "reads"))


@query
def samples(spark, sf_dir):
    groups = _get(spark, sf_dir, "reads").where("rg IS NOT NULL").select("rg").distinct()
    return counts.samples(groups.select(F.when(F.col("rg") != "rg2", F.upper("rg")).alias("sm")))


@query
def sort_coordinate(spark, sf_dir):
    reads = _get(spark, sf_dir, "reads").select("ord", "qname", "flag", "tid", "pos")
    return ordering.numbered(reads, [*ordering.coordinate_keys(), F.col("ord")])


@query
def sort_name(spark, sf_dir):
    reads = _get(spark, sf_dir, "reads").select("ord", "qname", "flag", "tid", "pos")
    return ordering.numbered(reads, [*ordering.name_keys(), F.col("ord")])


@query
def merge(spark, sf_dir):
    reads = _get(spark, sf_dir, "reads").select("ord", "qname", "flag", "tid", "pos")
    rows = filters.concatenate(_halves(reads))
    return ordering.numbered(rows, [*ordering.coordinate_keys(), F.col("src"), F.col("ord")])


@query
def merge_sorted(spark, sf_dir):
    """The same from two inputs that are sorted already: streams of ranges are merged, nothing is sorted again."""
    paths = []
    for half in _halves(_get(spark, sf_dir, "reads").select("ord", "qname", "flag", "tid", "pos")):
        paths.append(new_path(spark, "sorted"))
        merging.write_sorted(half, paths[-1])
    return merging.merge_sorted(spark, paths, rank="rank")


@query
def merge_read_groups(spark, sf_dir):
    halves = _halves(_get(spark, sf_dir, "reads").where("rg IS NOT NULL"))
    return headers.merge_ids([h.select(F.col("rg").alias("id"), F.upper("rg").alias("sm")).distinct() for h in halves])


@query
def cat(spark, sf_dir):
    reads = _get(spark, sf_dir, "reads").select("ord", "qname", "flag")
    return ordering.numbered(filters.concatenate(_halves(reads)), [F.col("src"), F.col("ord")])


@query
def collate(spark, sf_dir):
    from pyspark.sql import Window

    rows = ordering.collate(_get(spark, sf_dir, "reads").select("ord", "qname", "flag"), primaries_only=True)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("qname").orderBy("ord")).cast("long"))


@query
def head(spark, sf_dir):
    return filters.head(_get(spark, sf_dir, "reads"), 25).select(*SHOWN)


@query
def addreplacerg(spark, sf_dir):
    reads = _get(spark, sf_dir, "reads")
    return filters.set_read_group(reads, "new").select("ord", "rg").join(filters.set_read_group(reads, "new", "overwrite_all").select("ord", F.col("rg").alias("rg_all")), "ord")


@query
def reheader(spark, sf_dir):
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    return filters.reheader(reads, contigs.withColumn("name", F.concat(F.lit("chr"), "name"))).select("ord", "tid", "contig")


@query
def remap_contigs(spark, sf_dir):
    """The reads under the contig numbers of a header that names the contigs the other way round."""
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    return filters.remap_contigs(reads, contigs, contigs.withColumn("tid", 4 - F.col("tid"))).select("ord", F.col("tid").cast("int").alias("tid"), F.col("mtid").cast("int").alias("mtid"))


@query
def drop_tags(spark, sf_dir):
    return filters.drop_tags(_tagged(spark, sf_dir)).select("ord", "qname", "flag", "rg", "rx", F.size("tags").alias("n_tags"))


@query
def read_measures(spark, sf_dir):
    reads = _get(spark, sf_dir, "reads").where(placed())
    return reads.select("ord", end_position().alias("endp"), unclipped_5_prime().alias("pos5"), quality_sum().alias("qsum"))


@query
def markdup_flags(spark, sf_dir):
    return duplicates.mark(_get(spark, sf_dir, "reads")).select("ord", "flag")


@query
def markdup_remove(spark, sf_dir):
    return duplicates.mark(_get(spark, sf_dir, "reads"), remove=True).select("ord", "flag")


@query
def markdup_stats(spark, sf_dir):
    return duplicates.report(_get(spark, sf_dir, "reads"))


@query
def markdup_barcode(spark, sf_dir):
    return duplicates.mark(_get(spark, sf_dir, "reads"), barcode="rx").select("ord", "flag")


@query
def markdup_ancient(spark, sf_dir):
    return duplicates.mark(_get(spark, sf_dir, "reads"), ancient=True).select("ord", "flag")


@query
def sort_markdup(spark, sf_dir):
    marked = duplicates.mark(_get(spark, sf_dir, "reads")).select("ord", "qname", "flag", "tid", "pos")
    return ordering.numbered(marked, [*ordering.coordinate_keys(), F.col("ord")])


@query
def depth_covered(spark, sf_dir):
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    return depth.depth(reads, contigs, min_mapq=10)


@query
def depth_all(spark, sf_dir):
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    return depth.depth(reads, contigs, all_positions=True)


@query
def depth_bed(spark, sf_dir):
    reads, contigs, bed = _get(spark, sf_dir, "reads", "contigs", "bed")
    return depth.depth(reads, contigs, bed=bed.where("tid <> 2"))


@query
def coverage(spark, sf_dir):
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    return depth.coverage(reads, contigs, min_mapq=10, min_baseq=13)


@query
def coverage_subset(spark, sf_dir):
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    return depth.coverage(reads, contigs, regions=["ASIA", "EUROPE"], columns=["name", "numreads", "covbases", "meandepth"])


@query
def bedcov(spark, sf_dir):
    reads, bed = _get(spark, sf_dir, "reads", "bed")
    return intervals.bedcov(bed, _halves(reads), min_mapq=5)


@query
def ampliconstats(spark, sf_dir):
    reads, bed = _get(spark, sf_dir, "reads", "bed")
    return intervals.ampliconstats(bed, _halves(reads), min_mapq=5)


@query
def pileup_depth(spark, sf_dir):
    return pileup.pileup_depth(_get(spark, sf_dir, "reads"))


@query
def mpileup(spark, sf_dir):
    return pileup.mpileup(*_get(spark, sf_dir, "reads", "contigs", "refseq"), min_mapq=20)


@query
def mpileup_capped(spark, sf_dir):
    return pileup.mpileup(*_get(spark, sf_dir, "reads", "contigs", "refseq"), max_depth=20)


@query
def consensus(spark, sf_dir):
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    return pileup.consensus(reads, contigs)


@query
def fixmate(spark, sf_dir):
    return mates.fixmate(_get(spark, sf_dir, "reads"), add_tags=True).select("ord", "flag", "mtid", "mpos", "tlen", "mc", "ms")


@query
def fixmate_runs(spark, sf_dir):
    """Mates are sought in runs of one name in input order; a name that comes again later is another template."""
    reads = _get(spark, sf_dir, "reads").withColumn("qname", F.expr("concat('T', cast((ord div 4) % 50 as string))"))
    return mates.fixmate(mates.islands(reads), group="island").select("ord", "flag", "mtid", "mpos", "tlen")


@query
def fixmate_tags(spark, sf_dir):
    rows = mates.fixmate(_get(spark, sf_dir, "reads"), add_tags=True)
    rows = with_tags(rows, {"MC": ("Z", F.col("mc")), "ms": ("i", F.col("ms"))})
    return rows.select("ord", F.array_join(to_fields(F.col("tags")), " ").alias("fields"))


@query
def calmd_tags(spark, sf_dir):
    rows = sequences.calmd(*_get(spark, sf_dir, "reads", "refseq"))
    rows = with_tags(rows, {"NM": ("i", F.col("nm")), "MD": ("Z", F.col("md"))})
    return rows.select("ord", F.array_join(to_fields(F.col("tags")), " ").alias("fields"))


@query
def fixmate_remove_unpaired(spark, sf_dir):
    return filters.remove_unpaired(mates.fixmate(_get(spark, sf_dir, "reads"))).select("ord", "flag")


@query
def fastq_pairs(spark, sf_dir):
    return mates.fastq(_get(spark, sf_dir, "reads"), suffix=True)


@query
def fastq_collate(spark, sf_dir):
    return mates.fastq(_get(spark, sf_dir, "reads"), collate=True)


@query
def fastq_export(spark, sf_dir):
    return mates.fastq_text(mates.fastq(_get(spark, sf_dir, "reads"), suffix=True))


@query
def fasta_export(spark, sf_dir):
    return mates.fastq_text(mates.fastq(_get(spark, sf_dir, "reads")), fasta=True)


@query
def import_fastq(spark, sf_dir):
    rows = mates.fastq(_get(spark, sf_dir, "reads"), suffix=True)
    both = []
    for sink in ("r1", "r2"):
        part = rows.where(F.col("sink") == sink).withColumn("n", F.floor(F.col("ord") / 4))
        both.append(part.select("n", F.concat(F.lit("@"), "name", F.lit(" 1:N:0:ACGT")).alias("header"), "seq", "qual"))
    return mates.import_fastq(both[0], both[1].where("n % 7 <> 0"), barcode=True)


@query
def calmd_md_nm(spark, sf_dir):
    return sequences.calmd(*_get(spark, sf_dir, "reads", "refseq")).select("ord", "md", "nm")


@query
def calmd_nm(spark, sf_dir):
    return sequences.calmd(*_get(spark, sf_dir, "reads", "refseq")).select("ord", F.col("nm").cast("long").alias("nm"))


@query
def primer_reach(spark, sf_dir):
    return intervals.primer_reach(*_get(spark, sf_dir, "reads", "bed"))


@query
def ampliconclip(spark, sf_dir):
    return sequences.ampliconclip(*_get(spark, sf_dir, "reads", "bed")).select("ord", "pos", "cigar")


@query
def ampliconclip_hard(spark, sf_dir):
    return sequences.ampliconclip(*_get(spark, sf_dir, "reads", "bed"), hard=True).select("ord", "pos", "cigar", "seq", "qual")


@query
def dict_md5(spark, sf_dir):
    return sequences.sequence_dictionary(_get(spark, sf_dir, "transcripts"), assembly="asm").select("name", "length", "md5", "line")


@query
def fasta_index(spark, sf_dir):
    return sequences.fasta_index(_get(spark, sf_dir, "transcripts"))


@query
def faidx_regions(spark, sf_dir):
    rows = _get(spark, sf_dir, "transcripts")
    start = F.col("tid") % 60
    return sequences.slices(rows, rows.select("name", start.alias("start"), (start + 3 * F.col("size")).alias("end")))


@query
def fqidx(spark, sf_dir):
    reads = _get(spark, sf_dir, "reads").where(primary())
    records = reads.select(F.col("ord").alias("n"), F.col("qname").alias("name"), "seq", "qual")
    return sequences.fqidx(records, records.where("n % 5 = 0").select("name"))


@query
def tview(spark, sf_dir):
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    return sequences.tview(reads, contigs, "ASIA:400")


@query
def proper_pairs_by_contig(spark, sf_dir):
    reads, contigs = _get(spark, sf_dir, "reads", "contigs")
    rows = reads.where(primary() & mapped() & has(2)).groupBy("tid").agg(F.count("*").alias("n"), F.sum(F.abs("tlen").cast("long")).alias("span"))
    return contigs.join(rows, "tid").select("name", "n", "span")

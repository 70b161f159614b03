"""Text formats: SAM, FASTA, FASTQ and BED, read and written by Spark's text source, and their indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.cigar import end_position, placed, span
from readloom.functions.tags import complete, from_fields, tag, to_fields
from readloom.functions.text import parse_region
from readloom.operators import counts, mates
from readloom.operators.ordering import numbered
from readloom.schema import READS
from readloom.session import stash


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one or more files with their number from 0, files in order of path.

    A line knows its file, the start of its split, and its place in it; the number adds
    the sizes of the splits before, one row each.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select("value", meta["file_path"].alias("_f"), meta["file_block_start"].alias("_s"), F.monotonically_increasing_id().alias("_m"))
    rows = stash(rows, "lines")
    splits = rows.groupBy("_f", "_s").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))
    splits = splits.withColumn("_before", F.sum("_n").over(Window.orderBy("_f", "_s")) - F.col("_n"))
    return rows.join(F.broadcast(splits), ["_f", "_s"]).select((F.col("_before") + F.col("_m") - F.col("_m0")).alias("n"), "value")


def sam_header(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Side tables of the header lines: contigs, read_groups, programs, comments."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_m")).where(F.col("value").rlike("^@(HD|SQ|RG|PG|CO)\t"))
    lines = stash(lines, "header")

    def of(kind, **fields):
        own = lines.where(F.col("value").startswith(f"@{kind}\t"))
        return own.select("_m", *[F.regexp_extract("value", rf"\t{key}:([^\t]*)", 1).alias(c) for c, key in fields.items()])

    def table(kind, **fields):
        rows = of(kind, **fields)
        return rows.orderBy("_m").select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in fields])

    contigs = numbered(of("SQ", name="SN", length="LN"), [F.col("_m")], "_n")
    return {
        "contigs": contigs.select((F.col("_n") - 1).cast("int").alias("tid"), "name", F.col("length").cast("int").alias("length")),
        "read_groups": table("RG", id="ID", sm="SM", lb="LB", pl="PL", pu="PU", cn="CN", dt="DT", pi="PI", ds="DS"),
        "programs": table("PG", id="ID", pn="PN", vn="VN", cl="CL", pp="PP"),
        "comments": lines.where(F.col("value").startswith("@CO\t")).orderBy("_m").select(F.substring("value", 5, 1 << 30).alias("comment")),
    }


CORRUPT, REASON = "corrupt", "reason"


def read_sam(spark: SparkSession, path: str, contigs: DataFrame | None = None, *, bad: str = "fail", observation: Observation | None = None) -> DataFrame:
    """The alignments relation of SAM text.

    A line is bad if it has fewer than 11 fields, a number that is none or out of its
    range, a CIGAR that does not parse or does not fit the bases, qualities that do not fit the bases, or a
    reference that the header does not name. bad="fail" ends the job at the first of
    them and names it, "drop" leaves them out, "keep" returns them with nothing but
    `ord` set, the line in `corrupt` and what is wrong with it in `reason`. observation
    counts good and bad lines (`good`, `bad`) in the pass that reads them.
    """
    if bad not in ("fail", "drop", "keep"):
        raise ValueError(f"bad is fail, drop or keep, not {bad}")
    contigs = contigs if contigs is not None else sam_header(spark, path)["contigs"]
    f = F.split("value", "\t", -1)

    def field(k):
        return F.get(f, F.lit(k))

    def none(c, missing):
        return F.when(c != missing, c)

    def number(k, low, high):
        x = field(k).try_cast("int")
        return F.when(x.between(low, high), x)

    ranges = {"flag": (1, 0, 65535), "pos": (3, 0, 2**31 - 1), "mapq": (4, 0, 255), "mpos": (7, 0, 2**31 - 1), "tlen": (8, -(2**31) + 1, 2**31 - 1)}
    text = lambda k: F.coalesce(none(field(k), "*"), F.lit(""))
    rows = numbered_lines(spark, path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        F.col("n").alias("ord"),
        "value",
        (F.size(f) >= 11).alias("_whole"),
        none(field(0), "*").alias("qname"),
        *[number(*r).alias(c) for c, r in ranges.items()],
        field(2).alias("_ref"),
        text(5).alias("cigar"),
        F.when(field(6) == "=", field(2)).otherwise(field(6)).alias("_mref"),
        text(9).alias("seq"),
        text(10).alias("qual"),
        from_fields(F.slice(f, 12, 1 << 20)).alias("tags"),
    )
    for column, ref in (("tid", "_ref"), ("mtid", "_mref")):
        names = contigs.select(F.col("tid").alias(column), F.col("name").alias(ref))
        rows = rows.join(names, ref, "left")
    reason = F.when(~F.col("_whole"), "fields")
    for column in ranges:
        reason = reason.when(F.col(column).isNull(), column)
    reason = reason.when(~F.col("cigar").rlike(r"^(\d+[MIDNSHP=X])*$"), "cigar")
    reason = reason.when((F.col("cigar") != "") & (F.col("seq") != "") & (span("cigar", "MIS=X") != F.length("seq")), "cigar length")
    reason = reason.when((F.col("qual") != "") & (F.length("qual") != F.length("seq")), "qual length")
    for column, ref in (("tid", "_ref"), ("mtid", "_mref")):
        reason = reason.when(F.col(column).isNull() & (F.col(ref) != "*"), "reference")
    rows = rows.withColumn(REASON, reason)
    if observation is not None:
        rows = rows.observe(observation, F.count_if(F.col(REASON).isNull()).alias("good"), F.count_if(F.col(REASON).isNotNull()).alias("bad"))
    known = {"pos": none(F.col("pos"), 0), "mapq": none(F.col("mapq"), 255), "mpos": none(F.col("mpos"), 0), "rg": tag("RG"), "rx": tag("RX")}
    rows, names = rows.withColumns(known), [c.name for c in READS]
    if bad == "keep":
        ok = F.col(REASON).isNull()
        return rows.select("ord", *[F.when(ok, F.col(c)).alias(c) for c in names if c != "ord"], F.when(~ok, F.col("value")).alias(CORRUPT), REASON)
    if bad == "drop":
        return rows.where(F.col(REASON).isNull()).select(*names)
    stop = F.raise_error(F.concat(F.lit("bad SAM line "), F.col("ord").cast("string"), F.lit(" ("), F.col(REASON), F.lit("): "), F.substring("value", 1, 200)))
    return rows.withColumn("flag", F.when(F.col(REASON).isNull(), F.col("flag")).otherwise(stop.cast("int"))).select(*names)


def sam_lines(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ord, value): the SAM line of each row, with all its tags."""
    reads = reads.withColumn("tags", complete(reads))
    for column in ("tid", "mtid"):
        names = contigs.select(F.col("tid").alias(column), F.col("name").alias(f"_{column}"))
        reads = reads.join(names, column, "left")
    mate = F.when(F.col("mtid").isNull(), "*").when(F.col("mtid") == F.col("tid"), "=").otherwise(F.col("_mtid"))

    def star(c):
        return F.when(F.length(c) > 0, F.col(c)).otherwise("*")

    def number(c, missing=0):
        return F.coalesce(F.col(c), F.lit(missing)).cast("string")

    line = F.concat_ws("\t", F.coalesce("qname", F.lit("*")), number("flag"), F.coalesce("_tid", F.lit("*")), number("pos"), number("mapq", 255), star("cigar"), mate, number("mpos"), number("tlen"), star("seq"), star("qual"), to_fields(F.col("tags")))
    return reads.select("ord", line.alias("value"))


def header_lines(contigs: DataFrame, read_groups: DataFrame | None = None, programs: DataFrame | None = None, comments: DataFrame | None = None, order: str = "unsorted") -> DataFrame:
    """(section, n, value): the header lines of the side tables."""
    spark = contigs.sparkSession

    def fields(rows, kind, **keys):
        parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))) for c, k in keys.items() if c in rows.columns]
        return F.concat_ws("\t", F.lit(kind), *parts)

    out = spark.createDataFrame([(0, 0, f"@HD\tVN:1.6\tSO:{order}")], "section int, n long, value string")
    out = out.unionByName(contigs.select(F.lit(1).alias("section"), F.col("tid").cast("long").alias("n"), fields(contigs, "@SQ", name="SN", length="LN").alias("value")))
    sides = [(2, read_groups, "@RG", {"id": "ID", "sm": "SM", "lb": "LB", "pl": "PL", "pu": "PU", "cn": "CN", "dt": "DT", "pi": "PI", "ds": "DS"}), (3, programs, "@PG", {"id": "ID", "pn": "PN", "vn": "VN", "cl": "CL", "pp": "PP"})]
    for section, rows, kind, keys in sides:
        if rows is not None:
            out = out.unionByName(rows.select(F.lit(section).alias("section"), F.monotonically_increasing_id().alias("n"), fields(rows, kind, **keys).alias("value")))
    if comments is not None:
        out = out.unionByName(comments.select(F.lit(4).alias("section"), F.monotonically_increasing_id().alias("n"), F.concat(F.lit("@CO\t"), "comment").alias("value")))
    return out


def write_sam(reads: DataFrame, contigs: DataFrame, path: str, *, header: bool = True, order: str = "unsorted", **sides: DataFrame) -> None:
    """Part files of SAM text in the order of `ord`; the header, with the side tables read_groups, programs and comments, leads the first."""
    rows = sam_lines(reads, contigs).select(F.lit(9).alias("section"), F.col("ord").alias("n"), "value")
    if header:
        rows = header_lines(contigs, order=order, **sides).unionByName(rows)
    rows.orderBy("section", "n").select("value").write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name, sequence): one row per sequence, in order."""
    rows, names = _fasta_lines(spark, path)
    text = rows.groupBy("_of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("value").alias("v")))), lambda x: x["v"]), "").alias("sequence"))
    return names.join(text, "_of", "left").select("tid", "name", F.coalesce("sequence", F.lit("")).alias("sequence"))


def fasta_chunks(spark: SparkSession, path: str, lines: int = 1 << 12) -> DataFrame:
    """(tid, name, chunk, text): the sequences in pieces of so many lines, for references whose sequences do not fit a row."""
    rows, names = _fasta_lines(spark, path)
    rows = rows.withColumn("chunk", F.floor((F.col("n") - F.col("_of") - 1) / lines))
    text = rows.groupBy("_of", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("value").alias("v")))), lambda x: x["v"]), "").alias("text"))
    return names.join(text, "_of").select("tid", "name", "chunk", "text")


def _fasta_lines(spark: SparkSession, path: str):
    """Lines of bases (n, value, _of) with the number of the name line they belong to, and the names (_of, tid, name), numbered by themselves."""
    rows = numbered_lines(spark, path).where(F.col("value") != "")
    # Lines belong to the last name line before them: its number is a running maximum over blocks of lines.
    rows = rows.withColumns({"_b": F.floor(F.col("n") / (1 << 16)), "_h": F.when(F.col("value").startswith(">"), F.col("n"))})
    blocks = rows.groupBy("_b").agg(F.max("_h").alias("_last"))
    # One row per 65,536 lines: they are numbered in blocks of their own, then looked up by an equi join.
    blocks = blocks.select("_b", F.max("_last").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_open"))
    within = F.max("_h").over(Window.partitionBy("_b").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_in", within).join(blocks, "_b").withColumn("_of", F.coalesce("_in", "_open"))
    names = rows.where("_h IS NOT NULL").select("_of", F.split(F.substring("value", 2, 1 << 20), r"\s", 2)[0].alias("name"))
    names = numbered(names, [F.col("_of")], "_n").select("_of", (F.col("_n") - 1).cast("int").alias("tid"), "name")
    return rows.where("_h IS NULL").select("n", "value", "_of"), names


def write_fasta(reference: DataFrame, path: str, width: int = 60) -> None:
    """Part files of FASTA text in the order of tid, lines of `width` bases."""
    places = F.sequence(F.lit(1), F.greatest(F.length("sequence"), F.lit(1)), F.lit(width))
    lines = F.filter(F.transform(places, lambda at: F.substring(F.col("sequence"), at, F.lit(width))), lambda x: x != "")
    rows = reference.select("tid", F.posexplode(F.concat(F.array(F.concat(F.lit(">"), "name")), lines)).alias("k", "value"))
    rows.orderBy("tid", "k").select("value").write.text(path)


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name, length, offset, line_bases, line_width) of each sequence of a FASTA file: where its bases start and how its first line is cut.

    Offsets are bytes of the file, or of the files one after the other, with one byte at the end of each line.
    """
    lines = numbered_lines(spark, path).withColumn("_bytes", (F.octet_length("value") + 1).cast("long")).withColumn("_b", F.floor(F.col("n") / (1 << 16)))
    blocks = lines.groupBy("_b").agg(F.sum("_bytes").alias("_sum"))
    blocks = blocks.select("_b", (F.sum("_sum").over(Window.orderBy("_b")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_bytes").over(Window.partitionBy("_b").orderBy("n"))
    ends = lines.withColumn("_end", inside).join(blocks, "_b").where(F.col("value").startswith(">")).select(F.col("n").alias("_of"), (F.col("_before") + F.col("_end")).alias("offset"))
    rows, names = _fasta_lines(spark, path)
    size = F.octet_length(F.rtrim("value"))
    per = rows.groupBy("_of").agg(F.sum(size).alias("length"), F.min_by(size, "n").alias("bases"), F.min_by(F.octet_length("value") + 1, "n").alias("width"))
    zero = F.lit(0)
    return names.join(ends, "_of").join(per, "_of", "left").select("tid", "name", F.coalesce("length", zero).cast("long").alias("length"), "offset", F.coalesce("bases", zero).cast("long").alias("line_bases"), F.coalesce("width", zero).cast("long").alias("line_width"))


def fastq_index(spark: SparkSession, path: str) -> DataFrame:
    """(n, name, length, seq_offset, qual_offset) of each record of a FASTQ file."""
    lines = numbered_lines(spark, path).withColumn("_bytes", (F.octet_length("value") + 1).cast("long")).withColumn("_b", F.floor(F.col("n") / (1 << 16)))
    blocks = lines.groupBy("_b").agg(F.sum("_bytes").alias("_sum"))
    blocks = blocks.select("_b", (F.sum("_sum").over(Window.orderBy("_b")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_bytes").over(Window.partitionBy("_b").orderBy("n")) - F.col("_bytes")
    rows = lines.withColumn("_at", inside).join(blocks, "_b").select(F.floor(F.col("n") / 4).alias("n"), (F.col("n") % 4).alias("k"), "value", (F.col("_before") + F.col("_at")).alias("at"))
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = rows.groupBy("n").agg(pick(0, "value").alias("header"), pick(1, "value").alias("seq"), pick(1, "at").alias("seq_offset"), pick(3, "at").alias("qual_offset"))
    wide = wide.where("qual_offset IS NOT NULL AND header LIKE '@%'")
    return wide.select("n", F.split(F.substring("header", 2, 1 << 20), r"\s", 2)[0].alias("name"), F.octet_length("seq").cast("long").alias("length"), "seq_offset", "qual_offset")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(n, header, seq, qual) of strict four-line records; a cut record at the end goes."""
    rows = numbered_lines(spark, path).select(F.floor(F.col("n") / 4).alias("n"), (F.col("n") % 4).alias("k"), "value")
    wide = rows.groupBy("n").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(c) for k, c in ((0, "header"), (1, "seq"), (2, "_plus"), (3, "qual"))])
    return wide.where("qual IS NOT NULL AND header LIKE '@%'").select("n", "header", "seq", "qual")


def read_bed(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """(iv, tid, name, bstart, bend); numbers that do not parse are 0, short lines and comments go."""
    f = F.split("value", "\t")
    rows = numbered_lines(spark, path).where((F.col("value") != "") & ~F.col("value").startswith("#") & ~F.col("value").startswith("track") & (F.size(f) >= 3))
    rows = rows.select(F.col("n").alias("iv"), f[0].alias("_c"), F.get(f, F.lit(3)).alias("name"), *[F.coalesce(F.trim(f[k]).try_cast("int"), F.lit(0)).alias(c) for k, c in ((1, "bstart"), (2, "bend"))])
    return rows.join(contigs.select("tid", F.col("name").alias("_c")), "_c", "left").select("iv", "tid", "name", "bstart", "bend")


def write_fastq(rows: DataFrame, path: str, fasta: bool = False) -> None:
    """One folder per sink (r1, r2, orphan, singleton) with the records of mates.fastq() as text, in their order."""
    text = mates.fastq_text(rows, fasta=fasta)
    text.repartitionByRange("sink", "ord").sortWithinPartitions("sink", "ord").select("sink", "text").write.partitionBy("sink").text(path)


def write_bed(bed: DataFrame, contigs: DataFrame, path: str) -> None:
    """Part files of BED text in the order of iv."""
    rows = bed.join(contigs.select("tid", F.col("name").alias("_c")), "tid")
    rows.select("iv", F.concat_ws("\t", "_c", F.col("bstart").cast("string"), F.col("bend").cast("string"), "name").alias("value")).orderBy("iv").select("value").write.text(path)


def write_split(reads: DataFrame, path: str, tag: str = "RG") -> None:
    """One folder per value of a text tag, "unknown" where it is missing or no text."""
    reads.withColumn("value", counts.tag_value(reads, tag)).write.partitionBy("value").parquet(path)


SPANS = "_spans"


def write_layout(reads: DataFrame, path: str, shift: int = 14) -> None:
    """Parquet by contig, sorted by place, with the bin as a column; and the longest span on the reference of each contig's rows, in a folder in it."""
    rows = reads.withColumn("bin", F.shiftright(F.col("pos") - 1, shift)).withColumn("contig", F.col("tid"))
    rows.repartitionByRange(F.asc_nulls_last("tid"), F.asc_nulls_last("pos")).sortWithinPartitions(F.asc_nulls_last("tid"), F.asc_nulls_last("pos"), "flag", "qname").write.partitionBy("contig").parquet(path)
    spans = reads.where(placed()).groupBy("tid").agg(F.max(end_position() - F.col("pos") + 1).alias("span"))
    spans.write.parquet(f"{path.rstrip('/')}/{SPANS}")


def read_layout(spark: SparkSession, path: str, contigs: DataFrame, regions: list[str]) -> DataFrame:
    """Rows of a layout that overlap each region, once per region, with the region's number in `region`; "*" asks for rows without a contig.

    The contig is a literal, so other partitions are not listed; a row that overlaps
    starts at most the contig's longest span before the region, so both bounds on `pos`
    reach the row groups.
    """
    named = [(k, *parse_region(r)) for k, r in enumerate(regions) if r != "*"]
    asked = contigs.where(F.col("name").isin(*{n for _, n, _, _ in named})).select("tid", "name")
    known = {r.name: (r.tid, r.span) for r in asked.join(spark.read.parquet(f"{path.rstrip('/')}/{SPANS}"), "tid", "left").collect()}  # one row per contig asked for
    rows = spark.read.parquet(path)
    parts = [rows.where("contig IS NULL").withColumn("region", F.lit(k)) for k, r in enumerate(regions) if r == "*"]
    for k, name, begin, end in named:
        tid, span = known.get(name, (None, None))
        if span is None:
            continue
        begin, end = begin or 1, 2**31 - 1 if end is None else end
        part = rows.where((F.col("contig") == tid) & (F.col("pos") <= end) & (F.col("pos") >= begin - span + 1) & (end_position() >= begin))
        parts.append(part.withColumn("region", F.lit(k)))
    out = rows.where("false").withColumn("region", F.lit(0))
    for part in parts:
        out = out.unionByName(part)
    return out.drop("contig", "bin")

"""Reference tags, primer clipping, sequence lookups and the text view of a window."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.cigar import end_position, placed, ref_length
from readloom.functions.text import parse_position, parse_region
from readloom.functions.walks import clip, mismatches
from readloom.operators.intervals import primer_reach
from readloom.operators.pileup import reference_chunks

OPS = re.compile(r"(\d+)([MIDNSHP=X])")
CHUNK = 1 << 12


def reference_slices(rows: DataFrame, reference: DataFrame, chunk: int = CHUNK, name: str = "ref") -> DataFrame:
    """rows (ord, tid, pos, cigar, ..) with the reference bases under each read, null where it is not placed.

    The reference is cut into chunks with an overlap of one, so a read joins the chunk
    where it starts; a read that spans more than a chunk joins all it touches.
    """
    pieces = reference_chunks(reference, 2 * chunk, chunk)
    rows = rows.withColumns({"_span": F.when(placed(), ref_length()), "_k": F.floor((F.col("pos") - 1) / chunk).cast("int")})
    short = rows.where(F.col("_span").isNull() | (F.col("_span") <= chunk)).join(pieces, ["tid", "_k"], "left")
    short = short.withColumn(name, F.substring("_text", F.col("pos") - F.col("_k") * chunk, F.col("_span"))).drop("_k", "_text", "_span")
    wide = rows.where(F.col("_span") > chunk)
    ks = F.explode(F.sequence(F.col("_k"), F.floor((F.col("pos") + F.col("_span") - 2) / chunk).cast("int")))
    parts = wide.select("ord", "tid", "pos", "_span", ks.alias("_k")).join(pieces, ["tid", "_k"])
    joined = parts.groupBy("ord", "pos", "_span").agg(F.min("_k").alias("_k0"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.substring("_text", 1, chunk).alias("t")))), lambda x: x["t"]), "").alias("_all"))
    cut = joined.select("ord", F.substring("_all", F.col("pos") - F.col("_k0") * chunk, F.col("_span")).alias(name))
    return short.unionByName(wide.drop("_span", "_k").join(cut, "ord", "left"))


def calmd(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """reads with md and nm; null where unplaced, without bases, or past the reference. Only NM carries the distance."""
    rows = reference_slices(reads, reference, name="_ref").withColumn("_t", mismatches(ref="_ref"))
    return rows.select(*reads.columns, "_t.md", "_t.nm")


def ampliconclip(reads: DataFrame, bed: DataFrame, *, hard: bool = False) -> DataFrame:
    """reads clipped where primers cover an end; the start moves with a left clip and lengths stay right."""
    reach = primer_reach(reads.where("cigar <> ''"), bed).where("left > 0 OR right > 0")
    rows = reads.join(reach, "ord", "left")
    kept, cut = rows.where("left IS NULL").select(*reads.columns), rows.where("left IS NOT NULL")
    cut = clip(cut, hard=hard)
    changed = {"cigar": F.col("_c.cigar"), "pos": (F.col("pos") + F.col("_c.moved")).cast("int")}
    if hard:
        n = F.greatest(F.length("seq") - F.col("_c.cut_left") - F.col("_c.cut_right"), F.lit(0))
        changed |= {x: F.substring(x, F.col("_c.cut_left") + 1, n) for x in ("seq", "qual")}
    return kept.unionByName(cut.withColumns(changed).select(*reads.columns))


def sequence_dictionary(reference: DataFrame, *, assembly: str | None = None, species: str | None = None, uri: str | None = None) -> DataFrame:
    """(tid, name, length, md5, line) of each sequence; line is the header line."""
    rows = reference.select("tid", "name", F.length("sequence").cast("long").alias("length"), F.md5(F.upper("sequence")).alias("md5"))
    parts = [F.lit("@SQ"), F.concat(F.lit("SN:"), "name"), F.concat(F.lit("LN:"), F.col("length").cast("string")), F.concat(F.lit("M5:"), "md5")]
    parts += [F.lit(f"{k}:{v}") for k, v in (("AS", assembly), ("SP", species), ("UR", uri)) if v]
    return rows.withColumn("line", F.concat_ws("\t", *parts))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """(tid, name, length, md5) of sequences that come in chunks (tid, name, chunk, text).

    The digest of a sequence is carried over its chunks in order, by one task that holds
    one batch of them at a time; no row holds a whole sequence.
    """

    def run(batches):
        import hashlib

        last, digest, length, out = None, None, 0, []
        for batch in batches:
            for tid, name, text in zip(*(batch.column(c).to_pylist() for c in ("tid", "name", "text"))):
                if (tid, name) != last:
                    if last:
                        out.append((*last, length, digest.hexdigest()))
                    last, digest, length = (tid, name), hashlib.md5(), 0
                if text:
                    digest.update(text.upper().encode())
                    length += len(text)
            yield _digests(out)
            out = []
        yield _digests([(*last, length, digest.hexdigest())] if last else [])

    rows = chunks.select("tid", "name", "chunk", "text").repartition("tid").sortWithinPartitions("tid", "chunk")
    return rows.mapInArrow(run, "tid int, name string, length long, md5 string")


def _digests(rows: list):
    import pyarrow as pa

    kinds = (pa.int32(), pa.string(), pa.int64(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], names=["tid", "name", "length", "md5"])


def dictionary_lines(digests: DataFrame, *, assembly: str | None = None, species: str | None = None, uri: str | None = None) -> DataFrame:
    """(place, line): the dictionary as header lines, the first line and then the sequences in order; from chunk_digests()."""
    parts = [F.lit("@SQ"), F.concat(F.lit("SN:"), "name"), F.concat(F.lit("LN:"), F.col("length").cast("string")), F.concat(F.lit("M5:"), "md5")]
    parts += [F.lit(f"{k}:{v}") for k, v in (("AS", assembly), ("SP", species), ("UR", uri)) if v]
    head = digests.sparkSession.createDataFrame([(0, "@HD\tVN:1.6\tSO:unsorted")], "place long, line string")
    return head.unionByName(digests.select((F.col("tid") + 1).cast("long").alias("place"), F.concat_ws("\t", *parts).alias("line")))


def faidx(reference: DataFrame, regions: list[str]) -> DataFrame:
    """(region, sequence) slices, 1-based and clamped to the sequence."""
    out = None
    for spec in regions:
        name, start, end = parse_region(spec)
        low = max(1, start or 1)
        n = F.least(F.length("sequence"), F.lit(end if end is not None else 2**31 - 1)) - (low - 1)
        part = reference.where(F.col("name") == name).select(F.lit(spec).alias("region"), F.substring("sequence", F.lit(low), F.greatest(n, F.lit(0))).alias("sequence"))
        out = part if out is None else out.unionByName(part)
    return out


def slices(reference: DataFrame, regions: DataFrame) -> DataFrame:
    """(name, start, end, sequence) of a table of regions (name, start, end), 1-based and clamped."""
    low = F.greatest(F.col("start"), F.lit(1))
    n = F.greatest(F.least(F.col("end"), F.length("sequence")) - low + 1, F.lit(0)).cast("int")
    rows = regions.join(reference.select("name", "sequence"), "name")
    return rows.select("name", "start", "end", F.substring("sequence", low.cast("int"), n).alias("sequence"))


def fasta_index(reference: DataFrame) -> DataFrame:
    """(name, length) of each sequence."""
    return reference.select("name", F.length("sequence").cast("long").alias("length"))


def fqidx(fastq: DataFrame, names: DataFrame) -> DataFrame:
    """The last record (n, name, seq, qual) of each asked name."""
    last = fastq.join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.max_by(F.struct("seq", "qual"), "n").alias("r"))
    return last.select("name", "r.seq", "r.qual")


def window_reads(reads: DataFrame, contigs: DataFrame, position: str, *, width: int = 80, depth: int = 30) -> DataFrame:
    """The reads that a text view of a window may show: the first 4 x depth in coordinate order."""
    name, start = parse_position(position)
    tid = contigs.where(F.col("name") == name).select("tid")
    rows = reads.where(placed()).join(tid, "tid", "left_semi")
    rows = rows.where((end_position() >= start) & (F.col("pos") <= start + width - 1))
    return rows.orderBy("pos", "flag", "qname", "ord").limit(4 * depth).select("ord", "pos", "cigar", "seq")


def stack_rows(reads: list, start: int, width: int, depth: int) -> list[str]:
    """First-fit lines of the shown reads; what does not fit into depth lines is left out."""
    ends, lines = [], []
    for row in reads:
        at, q, first, text = row["pos"], 0, None, ""
        for n, op in OPS.findall(row["cigar"]):
            n = int(n)
            if op in "M=XDN":
                for k in range(n):
                    shown = "-" if op in "DN" else row["seq"][q + k : q + k + 1]
                    if shown and start <= at + k < start + width:
                        first = at + k if first is None else first
                        text += shown
                at += n
            if op in "MIS=X":
                q += n
        if first is None:
            continue
        for k in range(depth):
            if k == len(ends):
                ends.append(start - 2)
                lines.append([" "] * width)
            if first > ends[k] + 1 or ends[k] < start:
                lines[k][first - start : first - start + len(text)] = text
                ends[k] = first + len(text) - 1
                break
    return ["".join(x) for x in lines]


def tview(reads: DataFrame, contigs: DataFrame, position: str, *, width: int = 80, depth: int = 30) -> DataFrame:
    """(line, text) of a text view; it works on the bounded set of window_reads()."""
    shown = window_reads(reads, contigs, position, width=width, depth=depth).collect()
    lines = stack_rows(shown, parse_position(position)[1], width, depth)
    return reads.sparkSession.createDataFrame(list(enumerate(lines)), "line int, text string")


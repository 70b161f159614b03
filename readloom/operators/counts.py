"""Counting reports: flagstat, idxstats, stats, split counts, samples, index bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.cigar import end_position, mapq_or_missing, mapped, placed, primary, span
from readloom.operators.intervals import overlaps_any

MATES = "(flag & 1) <> 0 AND (flag & 12) = 0"
APART = f"{MATES} AND coalesce(tid, -1) <> coalesce(mtid, -1)"
#: What flagstat counts, in its order. The paired block is not restricted to primaries.
FLAGSTAT = {
    "total": "true",
    "primary": "(flag & 2304) = 0",
    "secondary": "(flag & 256) <> 0",
    "supplementary": "(flag & 2048) <> 0",
    "duplicates": "(flag & 1024) <> 0",
    "primary duplicates": "(flag & 1024) <> 0 AND (flag & 2304) = 0",
    "mapped": "(flag & 4) = 0",
    "primary mapped": "(flag & 4) = 0 AND (flag & 2304) = 0",
    "paired in sequencing": "(flag & 1) <> 0",
    "read1": "(flag & 1) <> 0 AND (flag & 64) <> 0",
    "read2": "(flag & 1) <> 0 AND (flag & 128) <> 0",
    "properly paired": f"{MATES} AND (flag & 2) <> 0",
    "with itself and mate mapped": MATES,
    "singletons": "(flag & 1) <> 0 AND (flag & 4) = 0 AND (flag & 8) <> 0",
    "with mate mapped to a different chr": APART,
    "with mate mapped to a different chr (mapQ>=5)": f"{APART} AND coalesce(mapq, 0) >= 5",
}


def flagstat(reads: DataFrame) -> DataFrame:
    """(metric, qc_pass, qc_fail): one global aggregate, then one row per metric."""
    columns = []
    for k, rule in enumerate(FLAGSTAT.values()):
        columns += [F.expr(f"count_if((flag & 512) = 0 AND {rule})").alias(f"p{k}"), F.expr(f"count_if((flag & 512) <> 0 AND {rule})").alias(f"f{k}")]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"p{k}").alias("qc_pass"), F.col(f"f{k}").alias("qc_fail")) for k, m in enumerate(FLAGSTAT)])
    return reads.agg(*columns).select(F.inline(rows))


def idxstats(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """(name, length, mapped, unmapped) per contig in header order, then "*" with the rows that have no place."""
    per = reads.where(placed()).groupBy("tid").agg(F.count_if(mapped()).alias("m"), F.count_if(~mapped()).alias("u"))
    named = contigs.join(per, "tid", "left").select("tid", "name", F.col("length").cast("long").alias("length"), F.coalesce("m", F.lit(0)).alias("mapped"), F.coalesce("u", F.lit(0)).alias("unmapped"))
    star = reads.where(~placed()).agg(F.count("*").alias("unmapped"))
    star = star.select(F.lit(2**31 - 1).alias("tid"), F.lit("*").alias("name"), F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("mapped"), "unmapped")
    return named.unionByName(star).orderBy("tid").drop("tid")


def stats_input(reads: DataFrame, *, min_mapq: int = 0, targets: DataFrame | None = None) -> DataFrame:
    """Primary rows that pass target intervals and mapping quality."""
    rows = reads.where(primary())
    if targets is not None:
        rows = overlaps_any(rows, targets)
    return rows.where(mapq_or_missing(min_mapq))


LONGEST_READ, LARGEST_INSERT = 1024, 8000  # beyond them the histograms of a report do not go
HISTOGRAMS = ("RL", "IS", "GCF", "MAPQ")


def profile(reads: DataFrame, *, min_mapq: int = 0, targets: DataFrame | None = None, histograms: bool = True) -> DataFrame:
    """All parts of the statistics from one scan: (section, key, n) and the sums of section 0, the summary.

    Each row gives a small item to each section it counts in, which the aggregate sums
    up before anything is shuffled. Sections 1 to 4 are the HISTOGRAMS. With targets the
    reads are scanned once more, to find those that overlap one.
    """
    kept = primary() & mapq_or_missing(min_mapq)
    if targets is not None:
        hit = overlaps_any(reads.where(primary()), targets).select("ord", F.lit(True).alias("_hit"))
        reads, kept = reads.join(hit, "ord", "left"), kept & F.coalesce("_hit", F.lit(False))
    n, gc = F.length("seq"), F.length(F.regexp_replace("seq", "[^GCgc]", ""))
    sums = {
        "raw_total": F.lit(1),
        "_primary": primary(),
        "sequences": kept,
        "reads_mapped": kept & mapped(),
        "reads_unmapped": kept & ~mapped(),
        "reads_paired": kept & F.expr("(flag & 1) <> 0"),
        "reads_properly_paired": kept & F.expr("(flag & 2) <> 0"),
        "reads_duplicated": kept & F.expr("(flag & 1024) <> 0"),
        "reads_qc_failed": kept & F.expr("(flag & 512) <> 0"),
        "total_length": F.when(kept, n),
        "bases_mapped": F.when(kept & mapped(), span("cigar", "M=X")),
        "bases_n": F.when(kept, n - F.length(F.regexp_replace("seq", "[Nn]", ""))),
        "_mapq": F.when(kept, F.col("mapq")),
        "reads_mq0": kept & (F.col("mapq") == 0),
    }
    keys = [
        F.lit(0),
        F.when(kept & (n <= LONGEST_READ), n),
        F.when(kept & F.expr("(flag & 1) <> 0") & (F.abs("tlen") <= LARGEST_INSERT), F.abs("tlen")),
        F.when(kept & (n > 0), F.floor(F.lit(100) * gc / n)),
        F.when(kept, F.col("mapq")),
    ][: 5 if histograms else 1]
    # Plain numbers first, so that nothing is computed again behind the explode.
    rows = reads.select(*[F.coalesce(x.cast("long"), F.lit(0)).alias(c) for c, x in sums.items()], *[x.cast("long").alias(f"_k{k}") for k, x in enumerate(keys)])
    items = F.array(*[F.struct(F.lit(k).alias("section"), F.col(f"_k{k}").alias("key")) for k in range(len(keys))])
    rows = rows.select(*sums, F.explode(items).alias("i")).where("i.key IS NOT NULL")
    # Only the summary's item carries sums.
    rows = rows.select("i.section", "i.key", *[F.when(F.col("i.section") == 0, F.col(c)).alias(c) for c in sums])
    return rows.groupBy("section", "key").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])


def stats_summary(reads: DataFrame, *, min_mapq: int = 0, targets: DataFrame | None = None) -> DataFrame:
    """One row of summary numbers; average_mapq is over mapped rows of all mapqs seen."""
    rows = profile(reads, min_mapq=min_mapq, targets=targets, histograms=False)
    rows = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns if c not in ("section", "key", "n")])  # of one row, or none
    return rows.withColumns({"filtered": F.col("_primary") - F.col("sequences"), "average_mapq": average_mapq()}).drop("_primary", "_mapq", "reads_mq0")


def average_mapq():
    return F.when(F.col("reads_mapped") > 0, F.col("_mapq") / F.col("reads_mapped")).otherwise(0.0)


def histogram(rows: DataFrame, value, name: str) -> DataFrame:
    return rows.select(value.cast("long").alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def read_lengths(reads: DataFrame, most: int = LONGEST_READ, **options) -> DataFrame:
    return histogram(stats_input(reads, **options).where(F.length("seq") <= most), F.length("seq"), "read_length")


def insert_sizes(reads: DataFrame, most: int = LARGEST_INSERT, **options) -> DataFrame:
    rows = stats_input(reads, **options).where("(flag & 1) <> 0").where(F.abs("tlen") <= most)
    return histogram(rows, F.abs("tlen"), "insert_size")


def gc_content(reads: DataFrame, **options) -> DataFrame:
    rows = stats_input(reads, **options).where(F.length("seq") > 0)
    gc = F.length(F.regexp_replace("seq", "[^GCgc]", ""))
    return histogram(rows, F.floor(F.lit(100) * gc / F.length("seq")), "gc_percent")


def mapping_qualities(reads: DataFrame, **options) -> DataFrame:
    return histogram(stats_input(reads, **options).where("mapq IS NOT NULL"), F.col("mapq"), "mapq")


def tag_value(reads: DataFrame, name: str) -> Column:
    """The text of a tag that holds text or a letter, "unknown" where there is none."""
    if name.lower() in ("rg", "rx") and name.lower() in reads.columns:
        return F.coalesce(name.lower(), F.lit("unknown"))
    held = F.map_filter("tags", lambda k, v: (k == name) & v["type"].isin("Z", "A"))
    return F.coalesce(F.get(F.map_values(held), F.lit(0))["value"], F.lit("unknown"))


def split_counts(reads: DataFrame, tag: str = "RG") -> DataFrame:
    """Rows per value of a tag; "unknown" where it is missing."""
    return reads.groupBy(tag_value(reads, tag).alias("value")).agg(F.count("*").alias("n"))


def samples(read_groups: DataFrame, expand: bool = False) -> DataFrame:
    """Distinct sample names in byte order, "-" where missing; with expand one row per read group."""
    rows = read_groups.select(F.coalesce("sm", F.lit("-")).alias("sample"))
    return rows.orderBy("sample") if expand else rows.distinct().orderBy("sample")


def index_bins(reads: DataFrame, min_shift: int = 14, depth: int = 5) -> DataFrame:
    """(tid, bin, n): rows per bin of the binning scheme, the smallest bin that holds the whole alignment."""
    begin, end = F.col("pos") - 1, end_position() - 1
    value, offset = F.lit(0), 0
    for level in range(1, depth + 1):
        shift = min_shift + 3 * (depth - level)
        offset += 1 << 3 * (level - 1)
        value = F.when(F.shiftright(begin, shift) == F.shiftright(end, shift), F.shiftright(begin, shift) + offset).otherwise(value)
    return reads.where(placed()).groupBy("tid", value.cast("int").alias("bin")).agg(F.count("*").alias("n"))



"""Record filters, column edits, unions and limits over the alignments relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions import tags
from readloom.functions.cigar import end_position, has, lacks, mapped, placed
from readloom.functions.text import parse_region
from readloom.schema import MATE_UNMAPPED, PAIRED


def view(reads: DataFrame, *, require: int = 0, exclude: int = 0, min_mapq: int = 0, drop_regions=(), match_contig: bool = False, contigs: DataFrame | None = None) -> DataFrame:
    """Rows that pass the flag masks and the mapping quality, which a missing one fails if a bound is set.

    drop_regions drops placed rows that overlap a span. As in the tool that users come
    from, the contig of such a region is ignored unless match_contig is set.
    """
    out = reads
    if require:
        out = out.where(has(require))
    if exclude:
        out = out.where(lacks(exclude))
    if min_mapq > 0:
        out = out.where(F.coalesce(F.col("mapq") >= min_mapq, F.lit(False)))
    for spec in drop_regions:
        name, start, end = parse_region(spec)
        inside = placed() & (end_position() >= (start or 1)) & (F.col("pos") <= (end if end is not None else 2**31 - 1))
        if match_contig:
            out = out.join(contigs.where(F.col("name") == name).select("tid", F.lit(True).alias("_named")), "tid", "left")
            out = out.where(~(inside & F.col("_named").isNotNull())).drop("_named")
        else:
            out = out.where(~F.coalesce(inside, F.lit(False)))
    return out.select(*reads.columns)


def view_regions(reads: DataFrame, contigs: DataFrame, regions: list[str], **filters) -> DataFrame:
    """Rows that overlap each region, once per region, with the region's number in `region`; "*" asks for rows without a contig."""
    kept, out = view(reads, **filters), None
    for k, spec in enumerate(regions):
        if spec == "*":
            part = kept.where("tid IS NULL")
        else:
            name, start, end = parse_region(spec)
            part = kept.join(contigs.where(F.col("name") == name).limit(1).select("tid"), "tid", "left_semi")
            part = part.where((end_position() >= (start or 1)) & (F.col("pos") <= (end if end is not None else 2**31 - 1)))
        part = part.select(*reads.columns, F.lit(k).alias("region"))
        out = part if out is None else out.unionByName(part)
    return out


def remove_unpaired(reads: DataFrame) -> DataFrame:
    """Without unmapped rows and paired rows whose mate is unmapped."""
    return reads.where(mapped() & ~(has(PAIRED) & has(MATE_UNMAPPED)))


def head(reads: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows in input order."""
    return reads.orderBy("ord").limit(n)


def concatenate(inputs: list[DataFrame]) -> DataFrame:
    """All rows in input order; `src` numbers the inputs, so (src, ord) is that order."""
    out = None
    for k, part in enumerate(inputs):
        part = part.withColumn("src", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def set_read_group(reads: DataFrame, group: str, mode: str = "orphan-only") -> DataFrame:
    """Set the read group: of all rows in mode overwrite_all, else of those that have none."""
    value = F.lit(group) if mode == "overwrite_all" else F.coalesce("rg", F.lit(group))
    return reads.withColumn("rg", value)


def drop_tags(reads: DataFrame) -> DataFrame:
    """Rows without any tag; the columns that show tags are null."""
    shown = {c: F.lit(None).cast("string") for c in ("rg", "rx") if c in reads.columns}
    return reads.withColumns({**shown, "tags": tags.empty()})


def reheader(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows under the names and lengths of another header; contig numbers stay."""
    names = contigs.select("tid", F.col("name").alias("contig"))
    return reads.join(names, "tid", "left")


def remap_contigs(reads: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """Contig numbers of another header with the same names and lengths; raises if they differ."""
    pairs = own.select("name", "length", F.col("tid").alias("old")).join(other.select("name", "length", F.col("tid").alias("new")), ["name", "length"], "full")
    if not pairs.where("old IS NULL OR new IS NULL").isEmpty():
        raise ValueError("the headers name different contigs")
    for column in ("tid", "mtid"):
        to = pairs.select(F.col("old").alias(column), "new")
        reads = reads.join(to, column, "left").withColumn(column, F.col("new")).drop("new")
    return reads

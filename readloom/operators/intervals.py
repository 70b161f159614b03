"""Joins of alignments with intervals, by contig and bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.cigar import end_position, mapq_or_missing, placed

BIN = 1 << 14


def overlap_join(rows: DataFrame, spans: DataFrame, *, start: str, end: str, width: int = BIN) -> DataFrame:
    """Pairs of rows (tid, start, end) and spans (tid, from_, to_) that overlap, each once.

    Both sides go to the bins they touch; the join is on contig and bin, so it deals
    out like any equi join, and a pair counts in the bin where the overlap starts.
    """
    left = rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    right = spans.where("from_ <= to_").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("from_") / width), F.floor(F.col("to_") / width))))
    meet = (F.col(start) <= F.col("to_")) & (F.col(end) >= F.col("from_"))
    once = F.col("_bin") == F.floor(F.greatest(F.col(start), F.col("from_")) / width)
    return left.join(right, ["tid", "_bin"]).where(meet & once).drop("_bin")


def merged(spans: DataFrame) -> DataFrame:
    """(tid, from_, to_): the union of spans as spans that do not overlap, one window per contig."""
    order = Window.partitionBy("tid").orderBy("from_", "to_")
    reach = F.max("to_").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.where("from_ <= to_").withColumn("_new", F.coalesce((F.col("from_") > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("_of", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("tid", "_of").agg(F.min("from_").alias("from_"), F.max("to_").alias("to_")).drop("_of")


def _placed(reads: DataFrame) -> DataFrame:
    return reads.where(placed()).withColumn("_end", end_position())


def overlaps_any(reads: DataFrame, bed: DataFrame) -> DataFrame:
    """Placed rows that overlap any interval (tid, bstart, bend; from 0, half open)."""
    spans = bed.select("tid", (F.col("bstart") + 1).alias("from_"), F.col("bend").alias("to_"))
    hit = overlap_join(_placed(reads).select("tid", "pos", "_end", "ord"), spans, start="pos", end="_end").select("ord").distinct()
    return reads.join(hit, "ord", "left_semi")


def _per_interval(bed: DataFrame, inputs: list[DataFrame], value, min_mapq: int, prefix: str) -> DataFrame:
    spans = bed.select("tid", "iv", (F.col("bstart") + 1).alias("from_"), F.col("bend").alias("to_"))
    rows = None
    for k, reads in enumerate(inputs):
        part = _placed(reads).where(mapq_or_missing(min_mapq)).select("tid", "pos", "_end", F.lit(k).alias("_input"))
        rows = part if rows is None else rows.unionByName(part)
    pairs = overlap_join(rows, spans, start="pos", end="_end")
    counted = pairs.groupBy("iv").agg(*[F.sum(F.when(F.col("_input") == k, value)).alias(f"{prefix}{k}") for k in range(len(inputs))])
    out = bed.join(counted, "iv", "left")
    return out.withColumns({f"{prefix}{k}": F.coalesce(f"{prefix}{k}", F.lit(0)).cast("long") for k in range(len(inputs))})


def bedcov(bed: DataFrame, inputs: list[DataFrame], *, min_mapq: int = 0) -> DataFrame:
    """Per interval and input the summed overlap of all reads; 0 for an unknown contig."""
    overlap = (F.least("_end", "to_") - F.greatest("pos", "from_") + 1).cast("long")
    out = _per_interval(bed, inputs, overlap, min_mapq, "cov_")
    return out.select("iv", "tid", "bstart", "bend", *[f"cov_{k}" for k in range(len(inputs))])


def ampliconstats(bed: DataFrame, inputs: list[DataFrame], *, min_mapq: int = 0) -> DataFrame:
    """Per amplicon and input the number of overlapping reads; starts count from 1."""
    out = _per_interval(bed, inputs, F.lit(1), min_mapq, "reads_")
    start = F.col("bstart") + 1
    return out.select(F.coalesce("name", F.format_string("amp%04d", "iv")).alias("amplicon"), "tid", start.alias("start"), F.col("bend").alias("end"), (F.col("bend") - start + 1).alias("length"), *[f"reads_{k}" for k in range(len(inputs))])


def primer_reach(reads: DataFrame, bed: DataFrame) -> DataFrame:
    """(ord, left, right): how many reference bases the primers cover at each end of a read."""
    spans = bed.select("tid", (F.col("bstart") + 1).alias("from_"), F.col("bend").alias("to_"))
    pairs = overlap_join(_placed(reads).select("ord", "tid", "pos", "_end"), spans, start="pos", end="_end")
    left = F.when((F.col("from_") <= F.col("pos")) & (F.col("to_") >= F.col("pos")), F.col("to_") - F.col("pos") + 1)
    right = F.when((F.col("from_") <= F.col("_end")) & (F.col("to_") >= F.col("_end")), F.col("_end") - F.col("from_") + 1)
    return pairs.groupBy("ord").agg(F.coalesce(F.max(left), F.lit(0)).cast("int").alias("left"), F.coalesce(F.max(right), F.lit(0)).cast("int").alias("right"))

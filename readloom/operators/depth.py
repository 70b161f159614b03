"""Depth and coverage by summed deltas; positions are never counted read by read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.cigar import end_position, mapped, mapq_or_missing, phred, placed, ref_length
from readloom.operators.intervals import merged, overlap_join

BLOCK = 1 << 16


def _aligned(reads: DataFrame, min_mapq: int) -> DataFrame:
    return reads.where(mapped() & placed() & mapq_or_missing(min_mapq) & (ref_length() > 0)).withColumn("_end", end_position())


def segments(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tid, begin, end, depth): maximal runs of one depth above 0 inside blocks of positions.

    rows has tid, pos and _end. A span is cut at block borders, so each block is a
    window of its own: a long contig is spread over many tasks. Deltas are summed per
    position before the window.
    """
    cut = rows.select("tid", "pos", "_end", F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor(F.col("_end") / block))).alias("block"))
    cut = cut.select("tid", "block", F.greatest(F.col("pos"), F.col("block") * block).alias("a"), F.least(F.col("_end"), F.col("block") * block + block - 1).alias("b"))
    deltas = cut.select("tid", "block", F.inline(F.array(F.struct(F.col("a").alias("p"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("p"), F.lit(-1).alias("d")))))
    summed = deltas.groupBy("tid", "block", "p").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("tid", "block").orderBy("p")
    runs = summed.select("tid", F.col("p").alias("begin"), (F.lead("p").over(order) - 1).alias("end"), F.sum("d").over(order).alias("depth"))
    return runs.where("depth > 0")


def depth(reads: DataFrame, contigs: DataFrame, *, min_mapq: int = 0, bed: DataFrame | None = None, all_positions: bool = False) -> DataFrame:
    """(name, pos, depth) of covered positions; with all_positions every position of contigs that have reads.

    With a bed, positions outside its intervals go; a contig that it does not name stays whole.
    """
    rows = _aligned(reads, min_mapq)
    runs = segments(rows)
    if bed is not None:
        # Runs are cut to the merged intervals of their contig before positions are exploded.
        spans = merged(bed.select("tid", (F.col("bstart") + 1).alias("from_"), F.col("bend").alias("to_")))
        inside = overlap_join(runs, spans, start="begin", end="end").select("tid", F.greatest("begin", "from_").alias("begin"), F.least("end", "to_").alias("end"), "depth")
        whole = runs.join(bed.select("tid").distinct(), "tid", "left_anti")
        runs = inside.unionByName(whole.select(*inside.columns))
    out = runs.select("tid", F.explode(F.sequence("begin", "end")).alias("pos"), "depth")
    if all_positions:
        used = contigs.join(rows.select("tid").distinct(), "tid", "left_semi")
        blocks = used.select("tid", F.col("length").cast("long").alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / BLOCK))).alias("block"))
        grid = blocks.repartition("tid", "block").select("tid", F.explode(F.sequence(F.col("block") * BLOCK + 1, F.least(F.col("length"), (F.col("block") + 1) * BLOCK))).alias("pos"))
        if bed is not None:
            listed = bed.select("tid").distinct()
            inside = overlap_join(grid.withColumn("_to", F.col("pos")), spans, start="pos", end="_to").select("tid", "pos")
            grid = inside.unionByName(grid.join(listed, "tid", "left_anti"))
        out = grid.join(out, ["tid", "pos"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    named = out.join(contigs.select("tid", "name"), "tid")
    return named.select("name", F.col("pos").cast("long").alias("pos"), F.col("depth").cast("long").alias("depth"))


COLUMNS = ["name", "startpos", "endpos", "numreads", "covbases", "coverage", "meandepth", "meanbaseq", "meanmapq"]


def coverage(reads: DataFrame, contigs: DataFrame, *, min_mapq: int = 0, min_baseq: int = 0, regions: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row per contig. Base qualities are taken one per reference position from the start of the read."""
    chosen = columns or COLUMNS
    if unknown := set(chosen) - set(COLUMNS):
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    rows = _aligned(reads, min_mapq).join(contigs.select("tid", "length"), "tid")
    rows = rows.withColumn("_n", F.greatest(F.least("_end", "length") - F.col("pos") + 1, F.lit(0)))
    used = F.filter(F.slice(phred(), F.lit(1), F.col("_n")), lambda q: q >= min_baseq)
    rows = rows.withColumn("_q", used)
    per = rows.groupBy("tid").agg(
        F.count("*").alias("numreads"),
        F.sum("_n").alias("_depth"),
        F.sum(F.aggregate("_q", F.lit(0).cast("long"), lambda a, q: a + q)).alias("_qsum"),
        F.sum(F.size("_q")).alias("_qn"),
        F.sum(F.coalesce("mapq", F.lit(0))).alias("_mapq"),
    )
    clipped = rows.withColumn("_end", F.least("_end", "length")).where("pos <= _end")
    covered = segments(clipped.select("tid", "pos", "_end")).groupBy("tid").agg(F.sum(F.col("end") - F.col("begin") + 1).alias("covbases"))
    out = contigs.join(per, "tid", "left").join(covered, "tid", "left")
    if regions:
        out = out.where(F.col("name").isin(regions))

    def ratio(a, b):
        return F.coalesce(F.when(b > 0, a / b), F.lit(0.0))

    zero = F.lit(0).cast("long")
    made = out.select(
        "tid",
        "name",
        F.lit(1).cast("long").alias("startpos"),
        F.col("length").cast("long").alias("endpos"),
        F.coalesce("numreads", zero).alias("numreads"),
        F.coalesce("covbases", zero).cast("long").alias("covbases"),
        ratio(F.lit(100.0) * F.col("covbases"), F.col("length")).alias("coverage"),
        ratio(F.col("_depth"), F.col("length")).alias("meandepth"),
        ratio(F.col("_qsum"), F.col("_qn")).alias("meanbaseq"),
        ratio(F.col("_mapq"), F.col("numreads")).alias("meanmapq"),
    )
    return made.orderBy("tid").select(*chosen)

"""Running counts over an append-only stream of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.functions.cigar import mapped, placed
from readloom.operators.counts import flagstat


def stream_flagstat(reads: DataFrame) -> DataFrame:
    """flagstat as state: one global aggregate, in complete or update mode."""
    return flagstat(reads)


def stream_contig_counts(reads: DataFrame) -> DataFrame:
    """Mapped and unmapped rows per contig."""
    return reads.where(placed()).groupBy("tid").agg(F.count_if(mapped()).alias("mapped"), F.count_if(~mapped()).alias("unmapped"))

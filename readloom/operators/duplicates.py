"""Duplicate marking: the best row of each group of equal template ends stays, found by an aggregate with partial sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom import schema as S
from readloom.functions.cigar import base_quality_sum, has, lacks, unclipped_5_prime
from readloom.session import stash


def _takes_part():
    return lacks(S.SECONDARY | S.SUPPLEMENTARY | S.UNMAPPED)


def keyed(reads: DataFrame, *, barcode: str | None = None, ancient: bool = False) -> DataFrame:
    """All rows, with `ends`, `is_pair` and `qsum`; ends is null where a row does not take part.

    An own end is the unclipped 5' position, a mate's end its plain start; the two ends
    of a pair are put in order. Rows without a contig have no key.
    """
    rows = reads
    tag = F.coalesce(F.col(barcode), F.lit("")) if barcode else F.lit("")

    def strand(bit):
        return F.lit(0) if ancient else F.when(has(bit), 1).otherwise(0)

    own = F.struct(F.col("tid"), unclipped_5_prime().alias("p"), strand(S.REVERSE).alias("s"), tag.alias("b"))
    mate = F.struct(F.col("mtid").alias("tid"), F.col("mpos").alias("p"), strand(S.MATE_REVERSE).alias("s"), tag.alias("b"))
    is_pair = has(S.PAIRED) & lacks(S.MATE_UNMAPPED) & F.col("mtid").isNotNull() & F.col("mpos").isNotNull()
    rows = rows.withColumns({"_own": own, "_mate": F.when(is_pair, mate), "is_pair": is_pair, "qsum": base_quality_sum()})
    ends = F.when(F.col("_mate").isNull(), F.struct(F.col("_own").alias("a"), F.lit(None).cast(rows.schema["_own"].dataType).alias("b")))
    ends = ends.when(F.col("_own") <= F.col("_mate"), F.struct(F.col("_own").alias("a"), F.col("_mate").alias("b")))
    ends = ends.otherwise(F.struct(F.col("_mate").alias("a"), F.col("_own").alias("b")))
    return rows.withColumn("ends", F.when(F.col("tid").isNotNull() & _takes_part(), ends)).drop("_own", "_mate")


def _keys(reads: DataFrame, **options) -> DataFrame:
    """(ord, qname, qsum, taken, is_pair, h1, h2) of all rows, written: 128 bits that know the ends, null where there are none.

    The folds over CIGAR and qualities are done here only; what follows looks at these narrow rows.
    """
    h = lambda *x: F.when(F.col("ends").isNotNull(), F.xxhash64(*x, "ends"))
    rows = keyed(reads, **options)
    return stash(rows.select("ord", "qname", "qsum", _takes_part().alias("taken"), "is_pair", h().alias("h1"), h(F.lit(1)).alias("h2")), "ends")


def _losers(keys: DataFrame) -> DataFrame:
    """(ord, is_pair) of the rows that are duplicates, from _keys()."""
    rows = keys.where("h1 IS NOT NULL")
    first = F.min(F.struct((-F.col("qsum")).alias("q"), F.coalesce("qname", F.lit("")).alias("name"), "ord"))
    best = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1").select("h1", "h2", F.col("first.ord").alias("best"))
    return rows.join(best, ["h1", "h2"]).where("ord <> best").select("ord", "is_pair")


def losers(reads: DataFrame, **options) -> DataFrame:
    """(ord, is_pair) of the rows that are duplicates: of equal ends all but the best by quality, name, order."""
    return _losers(_keys(reads, **options))


def mark(reads: DataFrame, *, remove: bool = False, **options) -> DataFrame:
    """reads with the duplicate bit set where a row loses; a bit that was set stays. remove drops the losers.

    Only the losers' numbers come back to the whole rows.
    """
    lost = losers(reads, **options).select("ord")
    if remove:
        return reads.join(lost, "ord", "left_anti").select(*reads.columns)
    rows = reads.join(lost.withColumn("_lost", F.lit(True)), "ord", "left")
    return rows.withColumn("flag", F.when(F.col("_lost"), F.col("flag").bitwiseOR(S.DUPLICATE)).otherwise(F.col("flag"))).select(*reads.columns)


def report(reads: DataFrame, *, remove: bool = False, **options) -> DataFrame:
    """One row of counts, from one scan of reads; optical duplicates are not told apart and count 0."""
    keys = _keys(reads, **options)
    lost = _losers(keys).agg(F.count_if("is_pair").alias("duplicate_pair"), F.count_if(~F.col("is_pair")).alias("duplicate_single"))
    known = F.col("h1").isNotNull()
    seen = keys.agg(F.count("*").alias("read"), F.count_if("taken").alias("examined"), F.count_if(known & F.col("is_pair")).alias("paired"), F.count_if(known & ~F.col("is_pair")).alias("single"))
    total = F.col("duplicate_pair") + F.col("duplicate_single")
    out = seen.crossJoin(lost)  # one row each
    return out.select("read", (F.col("read") - (total if remove else 0)).alias("written"), (F.col("read") - F.col("examined")).alias("excluded"), "examined", "paired", "single", "duplicate_pair", "duplicate_single", total.alias("duplicate_total"), F.lit(0).cast("long").alias("duplicate_optical"))

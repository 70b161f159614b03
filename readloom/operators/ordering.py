"""Coordinate and name order, merging, collating, and row numbers over a distributed sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.filters import concatenate
from readloom.session import stash


def coordinate_keys() -> list[Column]:
    return [F.asc_nulls_last("tid"), F.asc_nulls_last("pos"), F.col("flag"), F.coalesce("qname", F.lit(""))]


def name_keys() -> list[Column]:
    return [F.coalesce("qname", F.lit("")), F.col("flag"), F.asc_nulls_last("tid"), F.asc_nulls_last("pos")]


def sort(reads: DataFrame, by_name: bool = False) -> DataFrame:
    return reads.orderBy(*(name_keys() if by_name else coordinate_keys()), "ord")


def merge(inputs: list[DataFrame], by_name: bool = False) -> DataFrame:
    """All rows in one order; ties by input, then by place in it."""
    return concatenate(inputs).orderBy(*(name_keys() if by_name else coordinate_keys()), "src", "ord")


def collate(reads: DataFrame, primaries_only: bool = False) -> DataFrame:
    """Rows of a name together, in input order."""
    rows = reads.where("(flag & 2304) = 0") if primaries_only else reads
    return rows.repartition("qname").sortWithinPartitions("qname", "ord")


def numbered(rows: DataFrame, keys: list, name: str = "rank") -> DataFrame:
    """rows with their number from 1 in the order of keys; they are range-partitioned, sorted and written once."""
    return numbered_parts(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), name)


def numbered_parts(rows: DataFrame, name: str = "rank") -> DataFrame:
    """rows with their number from 1 in the order of their partitions and inside them.

    They are written once; the number is the place in the partition plus the sizes of
    the partitions before, one row each.
    """
    ordered = rows.withColumn("_at", F.monotonically_increasing_id())
    ordered = stash(ordered.withColumn("_part", F.shiftright("_at", 33)), "numbered")
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return ordered.join(F.broadcast(before), "_part").withColumn(name, place).drop("_at", "_part", "_before")

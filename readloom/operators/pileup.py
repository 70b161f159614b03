"""Pileup columns, mpileup rows and consensus lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.cigar import cigar_ops, mapped, mapq_or_missing, placed
from readloom.operators.depth import segments
from readloom.operators.ordering import numbered


def runs(reads: DataFrame, min_mapq: int, *carried) -> DataFrame:
    """(tid, carried .., ref, read, n): one row per run of aligned bases, where it starts in the reference and in the read."""
    rows = reads.where(mapped() & placed() & mapq_or_missing(min_mapq)).withColumn("_ops", cigar_ops())
    names = [c for c in dict.fromkeys(("tid", "pos", "seq", *carried))]
    rows = rows.select(*names, "_ops", F.posexplode("_ops").alias("_k", "_op")).where(F.col("_op.op").isin("M", "=", "X"))

    def before(kinds):
        return F.aggregate(F.slice("_ops", F.lit(1), F.col("_k")), F.lit(0), lambda a, o: a + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))

    rows = rows.withColumns({"ref": F.col("pos") + before("MDN=X"), "read": before("MIS=X") + 1})
    return rows.withColumn("n", F.least(F.col("_op.len"), F.length("seq") - F.col("read") + 1)).where("n > 0").select("tid", *carried, "ref", "read", "n")


def bases(reads: DataFrame, *carried: str, min_mapq: int = 0, min_baseq: int = 13) -> DataFrame:
    """(tid, pos, carried .., base, q): one row per aligned base; a base of low quality is N of quality 0.

    A run becomes an array of its bases before it is exploded, so a row carries no more than its base.
    """
    rows = runs(reads, min_mapq, *carried, *(c for c in ("seq", "qual") if c not in carried))
    letters = lambda c: F.split(F.substring(c, F.col("read"), F.col("n")), "")
    # Qualities may be missing or shorter than the bases.
    pairs = F.zip_with(letters("seq"), letters("qual"), lambda b, q: F.struct(b.alias("b"), F.coalesce(F.ascii(q) - 33, F.lit(0)).alias("q")))
    pairs = F.filter(pairs, lambda x: x["b"] != "")
    each = rows.select("tid", "ref", *carried, F.posexplode(pairs).alias("_i", "_x"))
    q = F.greatest(F.col("_x.q"), F.lit(0))
    low = q < min_baseq
    return each.select("tid", (F.col("ref") + F.col("_i")).alias("pos"), *carried, F.when(low, "N").otherwise(F.col("_x.b")).alias("base"), F.when(low, 0).otherwise(q).alias("q"))


def pileup_depth(reads: DataFrame, *, min_mapq: int = 0) -> DataFrame:
    """(tid, pos, depth) by summed deltas of the runs; no base is looked at."""
    rows = runs(reads, min_mapq).select("tid", F.col("ref").alias("pos"), (F.col("ref") + F.col("n") - 1).alias("_end"))
    out = segments(rows).select("tid", F.explode(F.sequence("begin", "end")).alias("pos"), "depth")
    return out.select("tid", F.col("pos").cast("int").alias("pos"), F.col("depth").cast("long").alias("depth"))


def reference_chunks(reference: DataFrame, size: int, block: int) -> DataFrame:
    """(tid, _k, _text): pieces of `size` bases from every `block`-th on; a row never holds more than its piece."""
    starts = F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / block).cast("int"))
    cut = F.transform(starts, lambda k: F.substring(F.col("sequence"), k * block + 1, F.lit(size)))
    return reference.where(F.length("sequence") > 0).select("tid", F.posexplode(cut).alias("_k", "_text"))


def mpileup(reads: DataFrame, contigs: DataFrame, reference: DataFrame, *, max_depth: int = 8000, block: int = 1 << 16, **options) -> DataFrame:
    """(name, pos, ref, depth, bases, quals): the first max_depth bases in coordinate order of their reads, '.' where they equal the reference."""
    order = [F.asc_nulls_last("tid"), F.asc_nulls_last("pos"), "flag", "qname", "ord"]
    # The place of a read in the order of all stands for what it is ordered by.
    placed_ = numbered(reads.select("ord", "qname", "flag", "tid", "pos", "mapq", "cigar", "seq", "qual"), order, "_r")
    per = bases(placed_, "_r", **options)
    within = Window.partitionBy("tid", "pos").orderBy("_r")
    per = per.withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= max_depth)
    columns = per.groupBy("tid", "pos").agg(F.array_sort(F.collect_list(F.struct("_r", "base", "q"))).alias("col"))
    joined = columns.withColumn("_k", F.floor((F.col("pos") - 1) / block).cast("int")).join(reference_chunks(reference, block, block), ["tid", "_k"], "left")
    base = F.substring("_text", F.col("pos") - F.col("_k") * block, F.lit(1))
    ref = F.when(F.length(base) > 0, base).otherwise("N")
    rows = joined.withColumn("ref", F.coalesce(ref, F.lit("N"))).drop("_text")
    shown = F.transform("col", lambda x: F.when(F.upper(x["base"]) == F.upper("ref"), ".").otherwise(F.upper(x["base"])))
    quals = F.transform("col", lambda x: F.char(F.least(x["q"] + 33, F.lit(126))))
    named = rows.join(contigs.select("tid", "name"), "tid")
    return named.select("name", F.col("pos").cast("long").alias("pos"), "ref", F.size("col").cast("long").alias("depth"), F.array_join(shown, "").alias("bases"), F.array_join(quals, "").alias("quals"))


def consensus(reads: DataFrame, contigs: DataFrame, *, call_fraction: float = 0.5, width: int = 60, **options) -> DataFrame:
    """(name, line, text): the FASTA lines of each covered contig up to its last covered position, N where nothing is called.

    The most frequent of A C G T N and other wins, the later of equals; other is N.
    """
    kind = F.upper("base")
    kind = F.when(kind.isin("A", "C", "G", "T", "N"), kind).otherwise("other")
    counts = bases(reads, **options).withColumn("_kind", kind).groupBy("tid", "pos")
    order = ["A", "C", "G", "T", "N", "other"]
    votes = counts.agg(*[F.count_if(F.col("_kind") == k).alias(f"votes_{k}") for k in order], F.count("*").alias("_total"))
    best = F.array_max(F.array(*[F.struct(F.col(f"votes_{k}").alias("n"), F.lit(i).alias("i"), F.lit(k if k != "other" else "N").alias("b")) for i, k in enumerate(order)]))
    called = votes.withColumn("_best", best)
    share = (F.col("_best.n").cast("float") / F.col("_total").cast("float")).cast("float")
    called = called.select("tid", "pos", F.when(share < F.lit(call_fraction).cast("float"), "N").otherwise(F.col("_best.b")).alias("b"))
    lines = called.withColumn("line", F.floor((F.col("pos") - 1) / width)).groupBy("tid", "line").agg(F.max("pos").alias("_last"), F.map_from_entries(F.collect_list(F.struct((F.col("pos") - F.col("line") * width).cast("int").alias("k"), "b"))).alias("_at"))
    last = lines.groupBy("tid").agg(F.max("_last").alias("_end"))
    blocks = last.select("tid", "_end", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_end") - 1) / (width * 4096)))).alias("_block"))
    grid = blocks.select("tid", "_end", F.explode(F.sequence(F.col("_block") * 4096, F.least(F.floor((F.col("_end") - 1) / width), F.col("_block") * 4096 + 4095))).alias("line"))
    full = grid.join(lines.drop("_last"), ["tid", "line"], "left").join(contigs.select("tid", "name"), "tid")
    n = F.least(F.lit(width).cast("long"), F.col("_end") - F.col("line") * width).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.coalesce(F.try_element_at("_at", k), F.lit("N"))), "")
    return full.select("name", "line", text.alias("text"))

"""Mate repair and FASTQ pairing: islands of one name, then windows inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom import schema as S
from readloom.functions.cigar import base_quality_sum, end_position, has, mapped, oriented, primary
from readloom.session import stash


def islands(rows: DataFrame, key: str = "qname", order: str = "ord") -> DataFrame:
    """rows with `island`: the order of the first row of each run of one key.

    Rows are range-partitioned by the order, so parts hold about as many rows each
    however dense the numbers are, and written. Runs are found inside the parts; what a part
    needs from those before it (their last key, their last run) is one row per part.
    """
    rows = stash(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ordered")
    within = Window.partitionBy("_part").orderBy(order)
    rows = rows.withColumns({"_first": F.row_number().over(within) == 1, "_before": F.lag(F.struct(key)).over(within)})
    rows = rows.withColumn("_start", F.when(F.col("_first") | ~F.struct(key).eqNullSafe(F.col("_before")), F.col(order)))
    # Each part's first and last key and the start of its last run: a part that goes on with the run before it takes that start over.
    parts = rows.groupBy("_part").agg(F.min_by(F.struct(key), order).alias("_head"), F.max_by(F.struct(key), order).alias("_tail"), F.min("_start").alias("_low"), F.max("_start").alias("_last"))
    over = Window.orderBy("_part")
    goes_on = F.lag("_tail").over(over).eqNullSafe(F.col("_head"))
    parts = parts.withColumn("_goes_on", F.coalesce(goes_on, F.lit(False)))
    # The run that is open at the end of a part: its own last one, unless the part is one run that goes on.
    own = F.when(~F.col("_goes_on") | (F.col("_last") > F.col("_low")), F.col("_last"))
    parts = parts.withColumn("_open", F.last(own, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    carried = parts.where("_goes_on").select("_part", F.col("_low").alias("_from"), F.col("_open").alias("_to"))
    running = F.max("_start").over(within.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("island", running).join(F.broadcast(carried), "_part", "left")
    return rows.withColumn("island", F.when(F.col("island") == F.col("_from"), F.col("_to")).otherwise(F.col("island"))).drop("_part", "_first", "_before", "_start", "_from", "_to")


def fixmate(reads: DataFrame, *, add_tags: bool = False, group: str = "qname") -> DataFrame:
    """Rows with mate fields repaired where a group has exactly two primaries.

    group names the template: the name for name-collated rows, or the `island` of
    islands(). A lone primary gets the mate-unmapped bit; other groups stay as they are.
    """
    rows = reads.withColumns({"_primary": primary(), "_end": end_position()})
    order = Window.partitionBy(group, "_primary").orderBy("ord")
    whole = Window.partitionBy(group, "_primary")
    own = F.struct("flag", "tid", "pos", "_end", "cigar", base_quality_sum().alias("qsum"))
    rows = rows.withColumns({"_own": own, "_place": F.row_number().over(order), "_n": F.count("*").over(whole)})
    rows = rows.withColumn("_mate", F.when(F.col("_primary") & (F.col("_n") == 2), F.when(F.col("_place") == 1, F.lead("_own").over(order)).otherwise(F.lag("_own").over(order))))
    pair = F.col("_mate").isNotNull()
    mate = lambda f: F.col(f"_mate.{f}")
    both = mapped() & ((mate("flag").bitwiseAND(S.UNMAPPED)) == 0)
    same = F.col("tid").eqNullSafe(mate("tid"))
    proper = both & same & F.col("tid").isNotNull() & (F.col("flag").bitwiseXOR(mate("flag")).bitwiseAND(S.REVERSE) != 0)
    cleared = F.col("flag").bitwiseAND(~(S.PROPER | S.MATE_REVERSE | S.MATE_UNMAPPED))
    bits = F.when((mate("flag").bitwiseAND(S.REVERSE)) != 0, S.MATE_REVERSE).otherwise(0) + F.when((mate("flag").bitwiseAND(S.UNMAPPED)) != 0, S.MATE_UNMAPPED).otherwise(0) + F.when(proper, S.PROPER).otherwise(0)
    lone = F.col("_primary") & (F.col("_n") == 1)
    flag = F.when(pair, cleared.bitwiseOR(bits)).when(lone, F.col("flag").bitwiseOR(S.MATE_UNMAPPED).bitwiseAND(~S.PROPER)).otherwise(F.col("flag"))
    start, other = F.coalesce("pos", F.lit(0)), F.coalesce(mate("pos"), F.lit(0))
    length = F.greatest("_end", mate("_end")) - F.least(start, other) + 1
    # The first of two with one start is the left one.
    left = (start < other) | ((start == other) & (F.col("_place") == 1))
    tlen = F.when(pair, F.when(both & same, F.when(left, length).otherwise(-length)).otherwise(0)).otherwise(F.col("tlen"))
    changed = {
        "flag": flag.cast("int"),
        "mtid": F.when(pair, mate("tid")).otherwise(F.col("mtid")),
        "mpos": F.when(pair, mate("pos")).otherwise(F.col("mpos")),
        "tlen": tlen.cast("int"),
    }
    if add_tags:
        changed |= {"mc": F.when(pair & (mate("cigar") != ""), mate("cigar")), "ms": F.when(pair, mate("qsum"))}
    return rows.withColumns(changed).drop("_primary", "_end", "_own", "_place", "_n", "_mate")


def fastq(reads: DataFrame, *, collate: bool = False, suffix: bool = False) -> DataFrame:
    """(ord, name, seq, qual, sink) of primaries as sequenced; sink is r1, r2, orphan or singleton.

    Neighbours of one name are a pair; with collate, names with exactly two rows are.
    A pair without a first read goes to orphan.
    """
    rows = reads.where(primary())
    if collate:
        order, whole = Window.partitionBy("qname").orderBy("ord"), Window.partitionBy("qname")
        rows = rows.withColumns({"_place": F.row_number().over(order), "_n": F.count("*").over(whole)})
    else:
        # A run of one name pairs off from its start; what is left over is single.
        rows = islands(rows)
        rows = rows.withColumn("_pair", F.floor((F.row_number().over(Window.partitionBy("island").orderBy("ord")) - 1) / 2))
        order, whole = Window.partitionBy("island", "_pair").orderBy("ord"), Window.partitionBy("island", "_pair")
        rows = rows.withColumns({"_place": F.row_number().over(order), "_n": F.count("*").over(whole)})
    read1 = has(S.READ1).cast("int")
    rows = rows.withColumns({"_r1": read1, "_mate1": F.when(F.col("_place") == 1, F.lead(read1).over(order)).otherwise(F.lag(read1).over(order))})
    pair = F.col("_n") == 2
    # The first row leads if it is a first read, else the second if that is one.
    leads = F.when(F.col("_place") == 1, F.col("_r1") == 1).otherwise((F.col("_r1") == 1) & (F.col("_mate1") == 0))
    any1 = (F.col("_r1") + F.col("_mate1")) > 0
    sink = F.when(~pair, "singleton").when(~any1, "orphan").when(leads, "r1").otherwise("r2")
    number = F.when(pair & any1, F.when(leads, 1).otherwise(2)).when(~pair & has(S.READ1), 1).when(~pair & has(S.READ2), 2)
    name = F.concat("qname", F.coalesce(F.concat(F.lit("/"), number.cast("string")), F.lit(""))) if suffix else F.col("qname")
    seq, qual = oriented()
    return rows.select("ord", name.alias("name"), seq.alias("seq"), qual.alias("qual"), sink.alias("sink"))


def fastq_text(rows: DataFrame, fasta: bool = False) -> DataFrame:
    """(ord, sink, text): four-line records, or two-line FASTA."""
    text = F.concat(F.lit(">"), "name", F.lit("\n"), "seq") if fasta else F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")
    return rows.select("ord", "sink", text.alias("text"))


def import_fastq(first: DataFrame, second: DataFrame | None, *, group: str = "1", barcode: bool = False) -> DataFrame:
    """Unaligned rows of one or two FASTQ relations (n, header, seq, qual), zipped by n.

    A first read without a second is kept and still flagged as paired; a second
    without a first goes. barcode keeps the last ':' part of the comment as BC.
    """
    first = first.withColumn("flag", F.lit(4 if second is None else 77)).withColumn("mate", F.lit(0))
    rows = first
    if second is not None:
        rows = first.unionByName(second.join(first.select("n"), "n", "left_semi").withColumn("flag", F.lit(141)).withColumn("mate", F.lit(1)))
    head = F.regexp_replace("header", "^@", "")
    name = F.regexp_replace(F.regexp_replace(F.split(head, r"\s", 2)[0], "(/1)+$", ""), "(/2)+$", "")
    code = F.element_at(F.split(F.get(F.split(head, r"\s", 2), F.lit(1)), ":"), -1)
    columns = ["n", "mate", name.alias("qname"), "flag", "seq", "qual", F.lit(group).alias("rg")]
    if barcode:
        columns.append(F.when(code.rlike(r"^[A-Za-z0-9+\-]+$"), code).alias("bc"))
    return rows.select(*columns)

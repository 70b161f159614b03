"""Column expressions over flags, CIGAR strings, bases and qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom import schema as S


def has(bits: int, flag: str | Column = "flag") -> Column:
    """All of the bits are set."""
    return _column(flag).bitwiseAND(bits) == bits


def lacks(bits: int, flag: str | Column = "flag") -> Column:
    """None of the bits is set."""
    return _column(flag).bitwiseAND(bits) == 0


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def primary() -> Column:
    return lacks(S.SECONDARY | S.SUPPLEMENTARY)


def mapped() -> Column:
    return lacks(S.UNMAPPED)


def placed() -> Column:
    return F.col("tid").isNotNull() & F.col("pos").isNotNull()


def mapq_or_missing(least: int) -> Column:
    """mapq >= least; a missing one passes."""
    return F.col("mapq").isNull() | (F.col("mapq") >= least)


def span(cigar: str | Column, kinds: str) -> Column:
    """Summed length of the operations of some kinds."""
    found = F.regexp_extract_all(_column(cigar), F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.coalesce(F.aggregate(found, F.lit(0), lambda a, x: a + x.cast("int")), F.lit(0))


def ref_length(cigar: str | Column = "cigar") -> Column:
    return span(cigar, "MDN=X")


def end_position(pos: str = "pos", cigar: str = "cigar") -> Column:
    """Last reference position, the start itself where nothing is aligned; null if unplaced."""
    return F.when(F.col(pos).isNotNull(), F.col(pos) + F.greatest(ref_length(cigar), F.lit(1)) - 1)


def leading_clip(cigar: str = "cigar") -> Column:
    return span(F.regexp_extract(cigar, r"^((\d+[SH])*)", 1), "SH")


def trailing_clip(cigar: str = "cigar") -> Column:
    return span(F.regexp_extract(cigar, r"((\d+[SH])*)$", 1), "SH")


def unclipped_5_prime() -> Column:
    """Where the read would start without clips, seen from its own strand."""
    forward = F.coalesce("pos", F.lit(0)) - leading_clip()
    reverse = F.coalesce("pos", F.lit(0)) + ref_length() - 1 + trailing_clip()
    return F.when(lacks(S.REVERSE), forward).otherwise(reverse)


def phred(qual: str | Column = "qual") -> Column:
    """Qualities as numbers from their text form."""
    chars = F.when(F.length(_column(qual)) > 0, F.split(_column(qual), "")).otherwise(F.array().cast("array<string>"))
    return F.transform(chars, lambda c: F.ascii(c) - 33)


def base_quality_sum(qual: str | Column = "qual", least: int = 15) -> Column:
    """Sum of the qualities that are at least `least`."""
    return F.coalesce(F.aggregate(phred(qual), F.lit(0), lambda a, q: a + F.when(q >= least, q).otherwise(0)), F.lit(0))


def cigar_ops(cigar: str | Column = "cigar") -> Column:
    """The operations as an array of (len, op)."""
    found = F.regexp_extract_all(_column(cigar), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_replace(x, "[^0-9]", "").cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def oriented(seq: str = "seq", qual: str = "qual") -> tuple[Column, Column]:
    """Bases and qualities as sequenced: mapped reverse reads are turned and complemented."""
    turn = mapped() & has(S.REVERSE)
    bases = F.translate(F.reverse(seq), "ACGTacgtNn", "TGCAtgcaNN")
    return F.when(turn, bases).otherwise(F.col(seq)), F.when(turn, F.reverse(qual)).otherwise(F.col(qual))

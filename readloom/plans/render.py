"""Text reports from typed results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import counts, duplicates


def percent(part: int, whole: int) -> str:
    return f"{100 * part / whole:.2f}%" if whole else "N/A"


def flagstat_text(result: DataFrame) -> str:
    """One line per metric, with shares where the report has them."""
    rows = {r.metric: (r.qc_pass, r.qc_fail) for r in result.collect()}
    of = {"mapped": "total", "primary mapped": "primary", "properly paired": "paired in sequencing", "singletons": "paired in sequencing"}
    lines = []
    for metric, (good, bad) in rows.items():
        name = "in total (QC-passed reads + QC-failed reads)" if metric == "total" else metric
        share = ""
        if metric in of:
            whole = rows[of[metric]]
            share = f" ({percent(good, whole[0])} : {percent(bad, whole[1])})"
        lines.append(f"{good} + {bad} {name}{share}")
    return "\n".join(lines) + "\n"


def flagstat_json(result: DataFrame) -> str:
    rows = result.collect()
    return json.dumps({"QC-passed reads": {r.metric: r.qc_pass for r in rows}, "QC-failed reads": {r.metric: r.qc_fail for r in rows}})


def table(result: DataFrame, header: bool = True, digits: int = 4) -> str:
    """Tab-separated rows; each header column gets its own #."""
    lines = ["\t".join(f"#{c}" for c in result.columns)] if header else []
    for row in result.collect():
        lines.append("\t".join(f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in row))
    return "\n".join(lines) + "\n"


def _fields(*parts):
    return F.concat_ws("\t", *[p.cast("string") for p in parts])


def idxstats_lines(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """(place, text): the report's lines, contigs in their order and then the rows without a place."""
    rows = counts.idxstats(reads, contigs).alias("r").join(contigs.select("tid", "name").alias("c"), F.col("r.name") == F.col("c.name"), "left")
    place = F.coalesce(F.col("c.tid").cast("long"), F.lit(1 << 40))
    return rows.select(place.alias("place"), _fields(*[F.col(f"r.{c}") for c in ("name", "length", "mapped", "unmapped")]).alias("text"))


# The summary's labels in their order, with the columns that they show.
SUMMARY = {
    "raw total sequences": "raw_total",
    "filtered sequences": "filtered",
    "reads mapped": "reads_mapped",
    "reads unmapped": "reads_unmapped",
    "reads duplicated": "reads_duplicated",
    "reads QC failed": "reads_qc_failed",
    "reads paired": "reads_paired",
    "reads properly paired": "reads_properly_paired",
    "reads MQ0": "reads_mq0",
    "total bases": "total_length",
    "bases mapped": "bases_mapped",
    "bases mapped (cigar)": "bases_mapped",
    "bases N": "bases_n",
}


def stats_lines(reads: DataFrame, **options) -> DataFrame:
    """(section, place, text): the summary lines, then the histograms of lengths, insert sizes, GC and mapping qualities; one scan of reads."""
    rows = counts.profile(reads, **options).withColumns({"filtered": F.col("_primary") - F.col("sequences"), "average_mapq": counts.average_mapq()})
    # A table without rows has a summary as well.
    rows = rows.unionByName(reads.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("key")), allowMissingColumns=True)
    rows = rows.groupBy("section", "key").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in rows.columns if c not in ("section", "key")])
    lines = [_fields(F.lit("SN"), F.lit(f"{label}:"), F.col(c)) for label, c in SUMMARY.items()]
    lines.append(_fields(F.lit("SN"), F.lit("average MAPQ:"), F.format_string("%.2f", "average_mapq")))
    line = lambda place, text: F.struct(place.cast("long").alias("place"), text.alias("text"))
    name = F.element_at(F.array(*map(F.lit, counts.HISTOGRAMS)), F.greatest(F.col("section"), F.lit(1)))
    own = F.when(F.col("section") == 0, F.array(*[line(F.lit(k), x) for k, x in enumerate(lines)])).otherwise(F.array(line(F.col("key"), _fields(name, F.col("key"), F.col("n")))))
    return rows.select("section", F.inline(own))


def markdup_lines(reads: DataFrame, **options) -> DataFrame:
    """(place, text): the report of marked duplicates."""
    row = duplicates.report(reads, **options)
    lines = [F.concat(F.lit(f"{c.replace('_', ' ').upper()} "), F.col(c).cast("string")) for c in row.columns]
    return row.select(F.posexplode(F.array(F.lit("COMMAND: markdup"), *lines)).alias("place", "text"))

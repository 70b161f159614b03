"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every run of `window` consecutive lines is hashed (two 64-bit hashes, so that a
chance collision stays out of reach at any corpus size). A window that occurs
more than once keeps its first occurrence, in the order of (id, text, line);
every line that a later occurrence covers is removed.

Defined results: a null text stays null with 0 lines; a document with fewer lines
than the window has no window and stays whole; empty lines count as lines; a null
id is an id like any other; rows that repeat id and text are one document and
give equal results; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import same


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """One row per row of docs: id, n_lines, n_removed, text without the removed lines."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    split = base.withColumn("lines", F.split("text", "\n", -1))

    def hashes(i):
        line = [F.get("lines", i + k) for k in range(window)]
        return F.struct((i.cast("int")).alias("line"), F.xxhash64(*line).alias("h1"), F.xxhash64(F.lit(1), *line[::-1]).alias("h2"))

    windows = (
        split.where(F.size("lines") >= window)
        .select("doc_id", "version", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - window), hashes)).alias("w"))
        .select("w.h1", "w.h2", F.struct("doc_id", "version", "w.line").alias("at"))
    )
    repeated = windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where(~F.col("at").eqNullSafe(F.col("first")))
    covered = (
        later.select("at.doc_id", "at.version", F.explode(F.sequence(F.col("at.line"), F.col("at.line") + (window - 1))).alias("line"))
        .groupBy("doc_id", "version")
        .agg(F.collect_set("line").alias("covered"))
    )
    # The lines go through the join as one text: a row is no larger than its document.
    joined = base.alias("d").join(covered.alias("c"), same("d", "c", "doc_id", "version"), "left").select("d.doc_id", "d.text", "c.covered")
    lines = F.split("text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered")), lambda i: F.get(lines, i))
    return joined.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
cov AS (SELECT DISTINCT doc_id, i + j AS line FROM later CROSS JOIN (VALUES (0), (1), (2)) AS v(j)),
rows_ AS (SELECT doc_id, unnest(ls) AS line_text, unnest(range(1, len(ls) + 1)) AS line FROM l),
kept AS (SELECT r.doc_id, string_agg(r.line_text, chr(10) ORDER BY r.line) AS text, count(*) AS n
         FROM rows_ r ANTI JOIN cov c ON r.doc_id = c.doc_id AND r.line = c.line GROUP BY r.doc_id)
SELECT d.doc_id, CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(l.ls), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

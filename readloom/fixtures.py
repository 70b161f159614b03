"""Alignment relations derived from the given tables, in SQL that Spark and DuckDB both accept.

The tables hold no alignments, so reads are derived from `orders` (two or three per
order), contigs and reference sequences from `region`, intervals from `nation`, and
a reference of many short sequences from `part`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PATTERN = "ACGTTGCAAGCTCCATGGATTACAGACCTTGAGTCAATCGGCTAAGCTNGATC"

READS = """
WITH t AS (
  SELECT o_orderkey AS k,
    ((o_orderkey + 1) * 7919   + 101) % 1000003 AS h1,
    ((o_orderkey + 1) * 104729 + 211) % 1000003 AS h2,
    ((o_orderkey + 1) * 15485863 + 307) % 1000003 AS h3,
    ((o_orderkey + 1) * 32452843 + 401) % 1000003 AS h4,
    ((o_orderkey + 1) * 49979687 + 503) % 1000003 AS h5,
    ((o_orderkey + 1) * 67867967 + 601) % 1000003 AS h6,
    ((o_orderkey + 1) * 86028121 + 701) % 1000003 AS h7
  FROM {orders}),
g AS (
  SELECT k, h3, h4, h5, h6, h7, CAST(h1 % 20 AS INT) AS kind, CAST(h2 % 5 AS INT) AS tid,
    1 + h3 % (1700 + 500 * (h2 % 5)) AS p1,
    CAST(h7 % 2 AS INT) AS swp,
    (CASE WHEN h4 % 25 = 0 THEN 512 ELSE 0 END) + (CASE WHEN h5 % 40 = 0 THEN 1024 ELSE 0 END) AS xf
  FROM t),
r AS (
  SELECT g.*, v.i,
    CASE WHEN v.i = 1 AND kind = 3 THEN (tid + 1) % 5 ELSE tid END AS rtid,
    CASE WHEN v.i = 1 AND kind = 3 THEN 1 + h6 % 1500
         WHEN v.i = 1 AND kind <> 1 THEN p1 + 60 + (h6 % 10) * 10 ELSE p1 END AS rpos,
    CASE WHEN v.i = 1 AND kind = 3 THEN tid WHEN kind = 3 THEN (tid + 1) % 5 ELSE tid END AS mtid,
    CASE WHEN v.i = 1 THEN p1 WHEN kind = 3 THEN 1 + h6 % 1500 WHEN kind = 1 THEN p1 ELSE p1 + 60 + (h6 % 10) * 10 END AS mpos,
    CASE WHEN (v.i = 1) = (swp = 1) THEN 64 ELSE 128 END AS rn,
    CASE WHEN v.i = 1 THEN h5 % 6 ELSE h4 % 6 END AS cg
  FROM g CROSS JOIN (VALUES (0), (1), (2)) AS v(i)
  WHERE v.i = 0 OR (v.i = 1 AND kind <> 2) OR (v.i = 2 AND kind IN (4, 5))),
f AS (
  SELECT r.*,
    xf + CASE
      WHEN kind = 0 THEN 1 + 4 + 8 + rn
      WHEN kind = 1 THEN 1 + rn + CASE WHEN i = 1 THEN 4 ELSE 8 END
      WHEN kind = 2 THEN 16 * swp
      WHEN kind = 3 THEN 1 + rn + CASE WHEN i = 1 THEN 16 ELSE 32 END
      WHEN kind = 6 THEN 1 + rn
      ELSE 1 + 2 + rn + (CASE WHEN i = 1 THEN 16 ELSE 32 END)
             + (CASE WHEN i = 2 AND kind = 4 THEN 2048 WHEN i = 2 THEN 256 ELSE 0 END) END AS flag
  FROM r)
SELECT k * 4 + i AS ord,
  concat('T', CAST(k AS VARCHAR(20))) AS qname,
  CAST(flag AS INT) AS flag,
  CASE WHEN kind = 0 THEN NULL ELSE rtid END AS tid,
  CASE WHEN kind = 0 THEN NULL ELSE CAST(rpos AS INT) END AS pos,
  CASE WHEN (h6 + i) % 61 = 60 THEN NULL ELSE CAST((h6 + i) % 61 AS INT) END AS mapq,
  CASE WHEN kind = 0 OR (kind = 1 AND i = 1) THEN ''
       WHEN cg = 3 THEN '5S35M' WHEN cg = 4 THEN '20M2I13M3D5M' WHEN cg = 5 THEN '30M4N4M6S' ELSE '40M' END AS cigar,
  CASE WHEN kind IN (0, 2) THEN NULL ELSE mtid END AS mtid,
  CASE WHEN kind IN (0, 2) THEN NULL ELSE CAST(mpos AS INT) END AS mpos,
  CAST(CASE WHEN kind IN (0, 1, 2, 3) THEN 0 WHEN i = 1 THEN p1 - rpos - 40 ELSE mpos - p1 + 40 END AS INT) AS tlen,
  concat(substr(repeat('ACGTTGCAAGCTCCATGGATTACAGACCTTGAGTCAATCGGCTAAGCTNGATC', 90), CAST(rtid * 7 + rpos AS INT), CAST(h7 % 40 AS INT)),
         substr('ACGTN', CAST(1 + (h5 + i) % 5 AS INT), 1),
         substr(repeat('ACGTTGCAAGCTCCATGGATTACAGACCTTGAGTCAATCGGCTAAGCTNGATC', 90), CAST(rtid * 7 + rpos + h7 % 40 + 1 AS INT), CAST(39 - h7 % 40 AS INT))) AS seq,
  substr(repeat('I?5B+F0:IIHG#A>FDCI;9876I4321/I.-,I*)(C&%$E!', 2), CAST(1 + (h4 + 11 * i) % 44 AS INT), 40) AS qual,
  CASE WHEN h3 % 9 = 0 THEN NULL ELSE concat('rg', CAST(h3 % 3 AS VARCHAR(1))) END AS rg,
  substr('ACGTGCAT', CAST(1 + h4 % 3 AS INT), 4) AS rx
FROM f
"""

CONTIGS = "SELECT r_regionkey AS tid, replace(r_name, ' ', '_') AS name, 2000 + 500 * r_regionkey AS length FROM {region}"
REFSEQ = f"SELECT r_regionkey AS tid, replace(r_name, ' ', '_') AS name, substr(repeat('{PATTERN}', 90), CAST(r_regionkey * 7 + 1 AS INT), CAST(2000 + 500 * r_regionkey AS INT)) AS sequence FROM {{region}}"
BED = """SELECT n_nationkey AS iv, n_nationkey % 5 AS tid, n_name AS name, (n_nationkey * 137) % 1500 AS bstart,
  (n_nationkey * 137) % 1500 + 50 + n_nationkey * 3 AS bend FROM {nation}"""

TRANSCRIPTS = f"""SELECT p_partkey AS tid, concat('p', CAST(p_partkey AS VARCHAR(20))) AS name,
  substr(repeat('{PATTERN}', 20), CAST(1 + p_partkey % 54 AS INT), CAST(20 + p_size * 7 AS INT)) AS sequence, p_size AS size FROM {{part}}"""

LONG_READS = """SELECT s_suppkey AS k, concat('L', CAST(s_suppkey AS VARCHAR(20))) AS qname, CAST(s_suppkey % 5 AS INT) AS tid,
  CAST(1 + (s_suppkey * 7919) % 900 AS INT) AS pos, CAST(1 + ((s_suppkey * 15485863) % 64) * ((s_suppkey * 15485863) % 64) AS INT) AS pieces FROM {supplier}"""

SOURCES = {"reads": (READS, "orders"), "contigs": (CONTIGS, "region"), "refseq": (REFSEQ, "region"), "bed": (BED, "nation"), "transcripts": (TRANSCRIPTS, "part"), "long_reads": (LONG_READS, "supplier")}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived relation over the tables in sf_dir."""
    text, base = SOURCES[name]
    return spark.sql(text, **{base: spark.read.parquet(f"{sf_dir}/{base}.parquet")})


def prelude() -> str:
    """The derived relations as common table expressions for DuckDB, with reference length and end of each read."""
    parts = [f"{name} AS ({text.replace('{' + base + '}', base)})" for name, (text, base) in SOURCES.items()]
    spans = "CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1), lambda x: CAST(x AS INT))), 0) AS INT)"
    ends = f"a AS (SELECT *, CASE WHEN pos IS NOT NULL THEN pos + greatest(reflen, 1) - 1 END AS endp FROM (SELECT *, {spans} AS reflen FROM reads))"
    return "WITH " + ",\n".join([*parts, ends])

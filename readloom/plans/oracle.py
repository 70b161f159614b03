"""DuckDB SQL of the registered queries, over the same derived relations."""

from __future__ import annotations

from readloom.fixtures import prelude
from readloom.operators.counts import FLAGSTAT
from readloom.plans.render import SUMMARY

P = prelude()
SHOWN = "ord, qname, flag, tid, pos, mapq, cigar"
QSUM = "CAST(coalesce(list_sum(list_transform(string_split(qual, ''), lambda c: CASE WHEN ascii(c) - 33 >= 15 THEN ascii(c) - 33 ELSE 0 END)), 0) AS INT)"
CLIP = "CAST(coalesce(list_sum(list_transform(regexp_extract_all(regexp_extract(cigar, '{}', 1), '(\\d+)', 1), lambda x: CAST(x AS INT))), 0) AS INT)"
POS5 = f"CASE WHEN flag & 16 = 0 THEN coalesce(pos, 0) - {CLIP.format('^((?:[0-9]+[SH])*)')} ELSE coalesce(pos, 0) + reflen - 1 + {CLIP.format('((?:[0-9]+[SH])*)$')} END"
COORDINATE = "tid ASC NULLS LAST, pos ASC NULLS LAST, flag, qname"
NAME = "qname, flag, tid ASC NULLS LAST, pos ASC NULLS LAST"

SQL = {}

SQL["flagstat"] = P + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) FILTER (WHERE (flag & 512) = 0 AND {r}) AS qc_pass, count(*) FILTER (WHERE (flag & 512) <> 0 AND {r}) AS qc_fail FROM reads" for m, r in FLAGSTAT.items())


def _share(part, whole):
    return f"CASE WHEN count(*) FILTER (WHERE {whole}) > 0 THEN CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE {part}) / count(*) FILTER (WHERE {whole}) END"


SQL["flagstat_percent"] = P + f""" SELECT {_share(FLAGSTAT['mapped'], 'true')} AS mapped_percent, {_share(FLAGSTAT['primary mapped'], FLAGSTAT['primary'])} AS primary_mapped_percent,
  {_share(FLAGSTAT['properly paired'], FLAGSTAT['paired in sequencing'])} AS properly_paired_percent, {_share(FLAGSTAT['singletons'], FLAGSTAT['paired in sequencing'])} AS singletons_percent
FROM reads WHERE flag & 512 = 0"""

SQL["idxstats"] = P + """ SELECT c.name, CAST(c.length AS BIGINT) AS length, count(*) FILTER (WHERE r.flag & 4 = 0) AS mapped, count(*) FILTER (WHERE r.flag & 4 <> 0) AS unmapped
FROM contigs c LEFT JOIN reads r ON r.tid = c.tid AND r.pos IS NOT NULL GROUP BY c.name, c.length
UNION ALL SELECT '*', 0, 0, count(*) FROM reads WHERE tid IS NULL OR pos IS NULL"""

SQL["view_require"] = P + f" SELECT {SHOWN} FROM reads WHERE flag & 3 = 3"
SQL["view_exclude"] = P + f" SELECT {SHOWN} FROM reads WHERE flag & 3844 = 0"
SQL["view_mapq"] = P + f" SELECT {SHOWN} FROM reads WHERE mapq >= 30"
SQL["view_region"] = P + f" SELECT {SHOWN} FROM a WHERE tid = 2 AND pos <= 700 AND endp >= 200 AND flag & 4 = 0"
SQL["view_multi_region"] = P + f""" SELECT CAST(0 AS INT) AS region, {SHOWN} FROM a WHERE tid = 2 AND pos <= 700 AND endp >= 200
UNION ALL SELECT 1, {SHOWN} FROM a WHERE tid = 2 AND pos <= 900 AND endp >= 500
UNION ALL SELECT 2, {SHOWN} FROM a WHERE tid = 3 AND endp >= 1000
UNION ALL SELECT 3, {SHOWN} FROM a WHERE tid = 4 AND pos IS NOT NULL
UNION ALL SELECT 4, {SHOWN} FROM a WHERE tid IS NULL"""
SQL["view_exclude_region"] = P + f" SELECT {SHOWN} FROM a WHERE tid IS NULL OR pos IS NULL OR pos > 1200 OR endp < 200"
SQL["view_count"] = P + " SELECT count(*) FILTER (WHERE pos <= 700 AND endp >= 200) + count(*) FILTER (WHERE pos <= 900 AND endp >= 500) AS n FROM a WHERE tid = 2 AND mapq >= 10"

_SUMMARY = """SELECT r.raw_total, k.sequences, k.reads_mapped, k.reads_unmapped, k.reads_paired, k.reads_properly_paired, k.reads_duplicated, k.reads_qc_failed,
  k.total_length, k.bases_mapped, k.bases_n, r.prim - k.sequences AS filtered, CASE WHEN k.reads_mapped > 0 THEN k.mq / k.reads_mapped ELSE 0.0 END AS average_mapq
FROM (SELECT count(*) AS raw_total, count(*) FILTER (WHERE flag & 2304 = 0) AS prim FROM reads) r,
 (SELECT count(*) AS sequences, count(*) FILTER (WHERE flag & 4 = 0) AS reads_mapped, count(*) FILTER (WHERE flag & 4 <> 0) AS reads_unmapped,
   count(*) FILTER (WHERE flag & 1 <> 0) AS reads_paired, count(*) FILTER (WHERE flag & 2 <> 0) AS reads_properly_paired, count(*) FILTER (WHERE flag & 1024 <> 0) AS reads_duplicated,
   count(*) FILTER (WHERE flag & 512 <> 0) AS reads_qc_failed, CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS total_length,
   CAST(coalesce(sum(CASE WHEN flag & 4 = 0 THEN coalesce(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[M=X]', 1), lambda x: CAST(x AS INT))), 0) END), 0) AS BIGINT) AS bases_mapped,
   CAST(coalesce(sum(length(seq) - length(replace(replace(seq, 'N', ''), 'n', ''))), 0) AS BIGINT) AS bases_n, CAST(coalesce(sum(mapq), 0) AS DOUBLE) AS mq FROM kept) k"""
SQL["stats_summary"] = P + ", kept AS (SELECT * FROM reads WHERE flag & 2304 = 0 AND (mapq IS NULL OR mapq >= 5)) " + _SUMMARY
SQL["stats_target_bed"] = P + ", kept AS (SELECT * FROM a WHERE flag & 2304 = 0 AND EXISTS (SELECT 1 FROM bed b WHERE b.tid = a.tid AND b.bstart + 1 <= a.endp AND b.bend >= a.pos)) " + _SUMMARY
SQL["stats_read_length"] = P + " SELECT CAST(length(seq) AS BIGINT) AS read_length, count(*) AS n FROM reads WHERE flag & 2304 = 0 AND length(seq) <= 1024 GROUP BY 1"
SQL["stats_insert_size"] = P + " SELECT CAST(abs(tlen) AS BIGINT) AS insert_size, count(*) AS n FROM reads WHERE flag & 2304 = 0 AND flag & 1 <> 0 AND abs(tlen) <= 8000 GROUP BY 1"
SQL["stats_gc"] = P + " SELECT CAST(100 * length(regexp_replace(seq, '[^GCgc]', '', 'g')) // length(seq) AS BIGINT) AS gc_percent, count(*) AS n FROM reads WHERE flag & 2304 = 0 AND length(seq) > 0 GROUP BY 1"
SQL["stats_mapq"] = P + " SELECT CAST(mapq AS BIGINT) AS mapq, count(*) AS n FROM reads WHERE flag & 2304 = 0 AND mapq IS NOT NULL GROUP BY 1"


def _bin(min_shift, depth):
    cases, t = [], ((1 << 3 * depth) - 1) // 7
    for level in range(depth, 0, -1):
        s = min_shift + 3 * (depth - level)
        t = ((1 << 3 * level) - 1) // 7
        cases.append(f"WHEN ((pos - 1) >> {s}) = ((endp - 1) >> {s}) THEN {t} + ((pos - 1) >> {s})")
    return "CAST(CASE " + " ".join(cases) + " ELSE 0 END AS INT)"


SQL["index_bins"] = P + f" SELECT tid, {_bin(8, 5)} AS bin, count(*) AS n FROM a WHERE tid IS NOT NULL AND pos IS NOT NULL GROUP BY 1, 2"
SQL["split_counts"] = P + " SELECT coalesce(rg, 'unknown') AS value, count(*) AS n FROM reads GROUP BY 1"
SQL["samples"] = P + " SELECT DISTINCT CASE WHEN rg <> 'rg2' THEN upper(rg) ELSE '-' END AS sample FROM reads WHERE rg IS NOT NULL"
SQL["sort_coordinate"] = P + f" SELECT ord, qname, flag, tid, pos, row_number() OVER (ORDER BY {COORDINATE}, ord) AS rank FROM reads"
SQL["sort_name"] = P + f" SELECT ord, qname, flag, tid, pos, row_number() OVER (ORDER BY {NAME}, ord) AS rank FROM reads"
_SRC = "SELECT *, CAST((ord // 4) % 2 AS INT) AS src FROM reads"
SQL["merge"] = P + f" SELECT ord, qname, flag, tid, pos, src, row_number() OVER (ORDER BY {COORDINATE}, src, ord) AS rank FROM ({_SRC})"
SQL["merge_sorted"] = SQL["merge"]
SQL["merge_read_groups"] = P + f""" SELECT CASE WHEN k > 1 THEN rg || '-' || CAST(k - 1 AS VARCHAR) ELSE rg END AS id, upper(rg) AS sm
FROM (SELECT rg, src, row_number() OVER (PARTITION BY rg ORDER BY src) AS k FROM (SELECT DISTINCT rg, src FROM ({_SRC}) WHERE rg IS NOT NULL))"""
SQL["cat"] = P + f" SELECT ord, qname, flag, src, row_number() OVER (ORDER BY src, ord) AS rank FROM ({_SRC})"
SQL["collate"] = P + " SELECT ord, qname, flag, row_number() OVER (PARTITION BY qname ORDER BY ord) AS place FROM reads WHERE flag & 2304 = 0"
SQL["head"] = P + f" SELECT {SHOWN} FROM reads ORDER BY ord LIMIT 25"
SQL["addreplacerg"] = P + " SELECT ord, coalesce(rg, 'new') AS rg, 'new' AS rg_all FROM reads"
SQL["reheader"] = P + " SELECT r.ord, r.tid, 'chr' || c.name AS contig FROM reads r LEFT JOIN contigs c ON c.tid = r.tid"
SQL["drop_tags"] = P + " SELECT ord, qname, flag, CAST(NULL AS VARCHAR) AS rg, CAST(NULL AS VARCHAR) AS rx, 0 AS n_tags FROM reads"
SQL["read_measures"] = P + f" SELECT ord, endp, {POS5} AS pos5, {QSUM} AS qsum FROM a WHERE tid IS NOT NULL AND pos IS NOT NULL"


def _markdup(barcode="''", ancient=False):
    s = ("0", "0") if ancient else ("CASE WHEN flag & 16 <> 0 THEN 1 ELSE 0 END", "CASE WHEN flag & 32 <> 0 THEN 1 ELSE 0 END")
    return P + f""", x AS (SELECT *, {POS5} AS pos5, {QSUM} AS qsum, {s[0]} AS s1, {s[1]} AS s2, {barcode} AS bc,
    flag & 1 <> 0 AND flag & 8 = 0 AND mtid IS NOT NULL AND mpos IS NOT NULL AS is_pair FROM a WHERE flag & 2308 = 0),
k AS (SELECT *, CASE WHEN NOT is_pair THEN [tid, pos5, s1] WHEN [tid, pos5, s1] <= [mtid, mpos, s2] THEN [tid, pos5, s1, mtid, mpos, s2] ELSE [mtid, mpos, s2, tid, pos5, s1] END AS ends FROM x WHERE tid IS NOT NULL),
lost AS (SELECT ord, is_pair FROM (SELECT *, row_number() OVER (PARTITION BY ends, bc ORDER BY qsum DESC, qname, ord) AS rn FROM k) WHERE rn > 1)"""


_MARKED = " SELECT ord, CASE WHEN ord IN (SELECT ord FROM lost) THEN CAST(flag | 1024 AS INT) ELSE flag END AS flag FROM reads"
SQL["markdup_flags"] = _markdup() + _MARKED
SQL["markdup_barcode"] = _markdup("coalesce(rx, '')") + _MARKED
SQL["markdup_ancient"] = _markdup(ancient=True) + _MARKED
SQL["markdup_remove"] = _markdup() + " SELECT ord, flag FROM reads WHERE ord NOT IN (SELECT ord FROM lost)"
SQL["markdup_stats"] = _markdup() + """ SELECT (SELECT count(*) FROM reads) AS read, (SELECT count(*) FROM reads) AS written, (SELECT count(*) FROM reads) - (SELECT count(*) FROM x) AS excluded,
  (SELECT count(*) FROM x) AS examined, (SELECT count(*) FROM k WHERE is_pair) AS paired, (SELECT count(*) FROM k WHERE NOT is_pair) AS single,
  count(*) FILTER (WHERE is_pair) AS duplicate_pair, count(*) FILTER (WHERE NOT is_pair) AS duplicate_single, count(*) AS duplicate_total, CAST(0 AS BIGINT) AS duplicate_optical FROM lost"""
SQL["sort_markdup"] = _markdup() + f", m AS ({_MARKED}) SELECT r.ord, r.qname, m.flag, r.tid, r.pos, row_number() OVER (ORDER BY r.tid ASC NULLS LAST, r.pos ASC NULLS LAST, m.flag, r.qname, r.ord) AS rank FROM reads r JOIN m ON m.ord = r.ord"

_DEPTH = ", dp AS (SELECT tid, CAST(p AS BIGINT) AS pos, count(*) AS depth FROM (SELECT tid, unnest(range(pos, endp + 1)) AS p FROM a WHERE flag & 4 = 0 AND tid IS NOT NULL AND pos IS NOT NULL AND reflen > 0 AND (mapq IS NULL OR mapq >= {})) GROUP BY 1, 2)"
SQL["depth_covered"] = P + _DEPTH.format(10) + " SELECT c.name, d.pos, d.depth FROM dp d JOIN contigs c ON c.tid = d.tid"
SQL["depth_all"] = P + _DEPTH.format(0) + """ SELECT g.name, g.pos, coalesce(d.depth, 0) AS depth FROM
 (SELECT tid, name, CAST(unnest(range(1, CAST(length AS BIGINT) + 1)) AS BIGINT) AS pos FROM contigs WHERE tid IN (SELECT tid FROM dp)) g LEFT JOIN dp d ON d.tid = g.tid AND d.pos = g.pos"""
SQL["depth_bed"] = P + _DEPTH.format(0) + " SELECT c.name, d.pos, d.depth FROM dp d JOIN contigs c ON c.tid = d.tid WHERE d.tid = 2 OR EXISTS (SELECT 1 FROM bed b WHERE b.tid <> 2 AND b.tid = d.tid AND d.pos > b.bstart AND d.pos <= b.bend)"
SQL["coverage"] = P + """, u AS (SELECT a.*, c.length, greatest(least(endp, c.length) - pos + 1, 0) AS n FROM a JOIN contigs c ON c.tid = a.tid
  WHERE flag & 4 = 0 AND pos IS NOT NULL AND reflen > 0 AND (mapq IS NULL OR mapq >= 10)),
q AS (SELECT *, list_filter(list_transform(string_split(substr(qual, 1, CAST(n AS INT)), ''), lambda c: ascii(c) - 33), lambda v: v >= 13) AS qs FROM u),
g AS (SELECT tid, count(*) AS numreads, sum(n) AS sd, sum(coalesce(list_sum(qs), 0)) AS qsum, sum(len(qs)) AS qn, sum(coalesce(mapq, 0)) AS mq FROM q GROUP BY tid),
cb AS (SELECT tid, count(DISTINCT p) AS covbases FROM (SELECT tid, unnest(range(pos, least(endp, length) + 1)) AS p FROM u) GROUP BY tid)
SELECT c.name, CAST(1 AS BIGINT) AS startpos, CAST(c.length AS BIGINT) AS endpos, coalesce(numreads, 0) AS numreads, coalesce(covbases, 0) AS covbases,
  coalesce(CAST(100.0 AS DOUBLE) * covbases / c.length, 0.0) AS coverage, coalesce(CAST(sd AS DOUBLE) / c.length, 0.0) AS meandepth,
  coalesce(CAST(qsum AS DOUBLE) / nullif(qn, 0), 0.0) AS meanbaseq, coalesce(CAST(mq AS DOUBLE) / nullif(numreads, 0), 0.0) AS meanmapq
FROM contigs c LEFT JOIN g ON g.tid = c.tid LEFT JOIN cb ON cb.tid = c.tid"""

_PAIR = "FROM bed b LEFT JOIN a ON a.tid = b.tid AND a.pos <= b.bend AND a.endp >= b.bstart + 1 AND (a.mapq IS NULL OR a.mapq >= 5)"
_COV = "CAST(coalesce(sum(CASE WHEN (a.ord // 4) % 2 = {0} THEN least(a.endp, b.bend) - greatest(a.pos, b.bstart + 1) + 1 END), 0) AS BIGINT) AS cov_{0}"
SQL["bedcov"] = P + f" SELECT b.iv, b.tid, b.bstart, b.bend, {_COV.format(0)}, {_COV.format(1)} {_PAIR} GROUP BY 1, 2, 3, 4"
SQL["ampliconstats"] = P + f""" SELECT b.name AS amplicon, b.tid, b.bstart + 1 AS start, b.bend AS "end", b.bend - b.bstart AS length,
  count(*) FILTER (WHERE (a.ord // 4) % 2 = 0) AS reads_0, count(*) FILTER (WHERE (a.ord // 4) % 2 = 1) AS reads_1 {_PAIR} GROUP BY 1, 2, 3, 4, 5"""

_PILE = """, op AS (SELECT *, regexp_extract_all(cigar, '(\\d+)[MIDNSHP=X]', 1) AS ns, regexp_extract_all(cigar, '\\d+([MIDNSHP=X])', 1) AS ks FROM a
  WHERE flag & 4 = 0 AND tid IS NOT NULL AND pos IS NOT NULL AND (mapq IS NULL OR mapq >= {0}) AND {1}),
run AS (SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM op),
st AS (SELECT *, CAST(ns[i] AS INT) AS n, pos + coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN ks[j] IN ('M', 'D', 'N', '=', 'X') THEN CAST(ns[j] AS INT) ELSE 0 END)), 0) AS rp,
  1 + coalesce(list_sum(list_transform(range(1, i), lambda j: CASE WHEN ks[j] IN ('M', 'I', 'S', '=', 'X') THEN CAST(ns[j] AS INT) ELSE 0 END)), 0) AS qp FROM run),
ev AS (SELECT tid, ord, pos AS start, flag, qname, seq, qual, rp, qp, unnest(range(0, n)) AS o FROM st WHERE ks[i] IN ('M', '=', 'X')),
b0 AS (SELECT *, CAST(rp + o AS INT) AS p, substr(seq, CAST(qp + o AS INT), 1) AS b, ascii(substr(qual, CAST(qp + o AS INT), 1)) - 33 AS q FROM ev WHERE qp + o <= length(seq)),
pb AS (SELECT tid, p, ord, start, flag, qname, CASE WHEN q < 13 THEN 'N' ELSE b END AS base, CASE WHEN q < 13 THEN 0 ELSE q END AS q FROM b0)"""


def _pile(mapq, rule="true"):
    return P + _PILE.replace("{0}", str(mapq)).replace("{1}", rule)


SQL["pileup_depth"] = _pile(0) + " SELECT tid, p AS pos, count(*) AS depth FROM pb GROUP BY 1, 2"
SQL["mpileup"] = _pile(20) + """, r AS (SELECT pb.*, c.name, coalesce(nullif(substr(f.sequence, pb.p, 1), ''), 'N') AS ref FROM pb JOIN contigs c ON c.tid = pb.tid LEFT JOIN refseq f ON f.tid = pb.tid)
SELECT name, CAST(p AS BIGINT) AS pos, ref, count(*) AS depth, string_agg(CASE WHEN upper(base) = upper(ref) THEN '.' ELSE upper(base) END, '' ORDER BY start, flag, qname, ord) AS bases,
  string_agg(chr(CAST(least(q + 33, 126) AS INT)), '' ORDER BY start, flag, qname, ord) AS quals FROM r GROUP BY name, p, ref"""
SQL["consensus"] = _pile(0) + """, v AS (SELECT tid, p, k, count(*) AS n FROM (SELECT tid, p, CASE WHEN upper(base) IN ('A', 'C', 'G', 'T', 'N') THEN upper(base) ELSE 'other' END AS k FROM pb) GROUP BY 1, 2, 3),
w AS (SELECT *, sum(n) OVER (PARTITION BY tid, p) AS total, row_number() OVER (PARTITION BY tid, p ORDER BY n DESC, CASE k WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 WHEN 'N' THEN 4 ELSE 5 END DESC) AS r FROM v),
c AS (SELECT tid, p, CASE WHEN CAST(n AS FLOAT) / CAST(total AS FLOAT) < CAST(0.5 AS FLOAT) OR k = 'other' THEN 'N' ELSE k END AS b FROM w WHERE r = 1),
g AS (SELECT tid, unnest(range(1, m + 1)) AS p FROM (SELECT tid, max(p) AS m FROM c GROUP BY tid))
SELECT n.name, CAST((g.p - 1) // 60 AS BIGINT) AS line, string_agg(coalesce(c.b, 'N'), '' ORDER BY g.p) AS text FROM g LEFT JOIN c ON c.tid = g.tid AND c.p = g.p JOIN contigs n ON n.tid = g.tid GROUP BY 1, 2"""

_FIX = f""", z AS (SELECT *, {QSUM} AS qsum, flag & 2304 = 0 AS prim FROM a),
y AS (SELECT *, count(*) OVER (PARTITION BY qname, prim) AS n, row_number() OVER (PARTITION BY qname, prim ORDER BY ord) AS pl FROM z),
j AS (SELECT y.*, m.flag AS f2, m.tid AS t2, m.pos AS p2, m.endp AS e2, m.cigar AS c2, m.qsum AS q2, m.ord IS NOT NULL AS pair
  FROM y LEFT JOIN y m ON y.prim AND m.prim AND y.n = 2 AND m.qname = y.qname AND m.ord <> y.ord),
h AS (SELECT *, flag & 4 = 0 AND f2 & 4 = 0 AS both_, tid IS NOT DISTINCT FROM t2 AS same_ FROM j),
fm AS (SELECT ord, CAST(CASE WHEN pair THEN ((flag | 42) - 42) + CASE WHEN f2 & 16 <> 0 THEN 32 ELSE 0 END + CASE WHEN f2 & 4 <> 0 THEN 8 ELSE 0 END
     + CASE WHEN both_ AND same_ AND tid IS NOT NULL AND xor(flag, f2) & 16 <> 0 THEN 2 ELSE 0 END
   WHEN prim AND n = 1 THEN ((flag | 8) | 2) - 2 ELSE flag END AS INT) AS flag,
  CASE WHEN pair THEN t2 ELSE mtid END AS mtid, CASE WHEN pair THEN p2 ELSE mpos END AS mpos,
  CAST(CASE WHEN NOT pair THEN tlen WHEN NOT (both_ AND same_) THEN 0
    WHEN coalesce(pos, 0) < coalesce(p2, 0) OR (coalesce(pos, 0) = coalesce(p2, 0) AND pl = 1) THEN greatest(endp, e2) - least(pos, p2) + 1 ELSE -(greatest(endp, e2) - least(pos, p2) + 1) END AS INT) AS tlen,
  CASE WHEN pair AND c2 <> '' THEN c2 END AS mc, CASE WHEN pair THEN q2 END AS ms FROM h)"""
SQL["fixmate"] = P + _FIX + " SELECT * FROM fm"
SQL["fixmate_remove_unpaired"] = P + _FIX + " SELECT ord, flag FROM fm WHERE flag & 4 = 0 AND NOT (flag & 1 <> 0 AND flag & 8 <> 0)"

_SEQ = "CASE WHEN flag & 4 = 0 AND flag & 16 <> 0 THEN translate(reverse(seq), 'ACGTacgtNn', 'TGCAtgcaNN') ELSE seq END AS seq, CASE WHEN flag & 4 = 0 AND flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual"


def _fastq(collate, suffix):
    if collate:
        head = ", w AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY ord) AS pl, count(*) OVER (PARTITION BY qname) AS n, qname AS grp, 0 AS sub FROM reads WHERE flag & 2304 = 0)"
    else:
        head = """, l AS (SELECT *, CASE WHEN lag(qname) OVER (ORDER BY ord) IS NOT DISTINCT FROM qname THEN 0 ELSE 1 END AS new FROM reads WHERE flag & 2304 = 0),
i AS (SELECT *, sum(new) OVER (ORDER BY ord) AS grp FROM l), s AS (SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY ord) - 1) // 2 AS sub FROM i),
w AS (SELECT *, row_number() OVER (PARTITION BY grp, sub ORDER BY ord) AS pl, count(*) OVER (PARTITION BY grp, sub) AS n FROM s)"""
    return P + head + f""", e AS (SELECT x.*, x.flag & 64 <> 0 AS a1, m.flag & 64 <> 0 AS b1 FROM w x LEFT JOIN w m ON x.n = 2 AND m.grp = x.grp AND m.sub = x.sub AND m.ord <> x.ord),
d AS (SELECT *, CASE WHEN n <> 2 THEN 'singleton' WHEN NOT (a1 OR b1) THEN 'orphan' WHEN (pl = 1 AND a1) OR (pl = 2 AND a1 AND NOT b1) THEN 'r1' ELSE 'r2' END AS sink FROM e),
fq AS (SELECT ord, qname{" || CASE WHEN sink = 'r1' THEN '/1' WHEN sink = 'r2' THEN '/2' WHEN sink = 'singleton' AND flag & 64 <> 0 THEN '/1' WHEN sink = 'singleton' AND flag & 128 <> 0 THEN '/2' ELSE '' END" if suffix else ""} AS name, {_SEQ}, sink FROM d)"""


SQL["fastq_pairs"] = _fastq(False, True) + " SELECT * FROM fq"
SQL["fastq_collate"] = _fastq(True, False) + " SELECT * FROM fq"
SQL["fastq_export"] = _fastq(False, True) + " SELECT ord, sink, '@' || name || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS text FROM fq"
SQL["fasta_export"] = _fastq(False, False) + " SELECT ord, sink, '>' || name || chr(10) || seq AS text FROM fq"
SQL["import_fastq"] = _fastq(False, False) + """ SELECT ord // 4 AS n, CAST(CASE WHEN sink = 'r1' THEN 0 ELSE 1 END AS INT) AS mate, name AS qname, CAST(CASE WHEN sink = 'r1' THEN 77 ELSE 141 END AS INT) AS flag, seq, qual, '1' AS rg, 'ACGT' AS bc
FROM fq WHERE sink = 'r1' OR (sink = 'r2' AND (ord // 4) % 7 <> 0)"""

_NM = _PILE.replace("flag & 4 = 0 AND ", "").replace("{0}", "0").replace("mapq IS NULL OR mapq >= 0", "true").replace("{1}", "true")
SQL["calmd_nm"] = P + _NM + """, mm AS (SELECT b0.ord, count(*) AS bad FROM b0 JOIN refseq f ON f.tid = b0.tid WHERE upper(b0.b) <> upper(substr(f.sequence, b0.p, 1)) GROUP BY 1)
SELECT a.ord, CASE WHEN a.tid IS NOT NULL AND a.pos IS NOT NULL AND length(a.seq) > 0 AND a.pos + a.reflen - 1 <= c.length THEN
  coalesce(mm.bad, 0) + CAST(coalesce(list_sum(list_transform(regexp_extract_all(a.cigar, '(\\d+)[ID]', 1), lambda x: CAST(x AS INT))), 0) AS BIGINT) END AS nm
FROM a LEFT JOIN contigs c ON c.tid = a.tid LEFT JOIN mm ON mm.ord = a.ord"""
_MD = """, me AS (SELECT b0.ord, b0.p, upper(b0.b) = upper(substr(f.sequence, b0.p, 1)) AS ok, upper(substr(f.sequence, b0.p, 1)) AS letter FROM b0 JOIN refseq f ON f.tid = b0.tid
  UNION ALL SELECT st.ord, CAST(st.rp AS INT), false, '^' || upper(substr(f.sequence, CAST(st.rp AS INT), st.n)) FROM st JOIN refseq f ON f.tid = st.tid WHERE st.ks[st.i] = 'D'),
cm AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY ord ORDER BY p) AS c FROM me),
ce AS (SELECT ord, p, letter, c, c - coalesce(lag(c) OVER (PARTITION BY ord ORDER BY p), 0) AS run FROM cm WHERE NOT ok),
ct AS (SELECT ord, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS total FROM me GROUP BY 1),
cs AS (SELECT ord, string_agg(CAST(run AS VARCHAR) || letter, '' ORDER BY p) AS t, max(c) AS last_ FROM ce GROUP BY 1)"""
SQL["calmd_md_nm"] = f"""WITH nm AS ({SQL["calmd_nm"]}), md AS ({P + _NM + _MD} SELECT a.ord, coalesce(cs.t, '') || CAST(coalesce(ct.total, 0) - coalesce(cs.last_, 0) AS VARCHAR) AS md FROM a LEFT JOIN cs ON cs.ord = a.ord LEFT JOIN ct ON ct.ord = a.ord)
SELECT nm.ord, CASE WHEN nm.nm IS NOT NULL THEN md.md END AS md, CAST(nm.nm AS INT) AS nm FROM nm JOIN md ON md.ord = nm.ord"""
_REACH = """SELECT a.ord, CAST(coalesce(max(CASE WHEN b.bstart + 1 <= a.pos AND b.bend >= a.pos THEN b.bend - a.pos + 1 END), 0) AS INT) AS "left",
  CAST(coalesce(max(CASE WHEN b.bstart + 1 <= a.endp AND b.bend >= a.endp THEN a.endp - b.bstart END), 0) AS INT) AS "right"
FROM a JOIN bed b ON b.tid = a.tid AND b.bstart + 1 <= a.endp AND b.bend >= a.pos GROUP BY a.ord"""
SQL["primer_reach"] = P + " " + _REACH
# A clip ends at the first aligned base that has enough reference bases before it, one from the right at the last that has enough behind it.
_CLIPS = P + f""", pr AS ({_REACH}),
co AS (SELECT a.ord, pr."left" AS l, pr."right" AS r, regexp_extract_all(cigar, '(\\d+)[MIDNSHP=X]', 1) AS ns, regexp_extract_all(cigar, '\\d+([MIDNSHP=X])', 1) AS ks
  FROM a JOIN pr ON pr.ord = a.ord WHERE a.cigar <> '' AND (pr."left" > 0 OR pr."right" > 0)),
cu AS (SELECT ord, l, r, i, ks[i] AS k, unnest(range(CAST(ns[i] AS INT))) AS o FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS i FROM co)),
cw AS (SELECT *, sum(CASE WHEN k IN ('M', 'D', 'N', '=', 'X') THEN 1 ELSE 0 END) OVER w AS rf, sum(CASE WHEN k IN ('M', 'I', 'S', '=', 'X') THEN 1 ELSE 0 END) OVER w AS rd, row_number() OVER w AS u
  FROM cu WINDOW w AS (PARTITION BY ord ORDER BY i, o)),
tot AS (SELECT ord, max(rf) AS trf, max(rd) AS trd, max(u) AS tu FROM cw GROUP BY 1),
cf AS (SELECT cw.ord, l, r, trf, trd, tu, min(u) FILTER (WHERE k IN ('M', '=', 'X') AND rf - 1 >= l) AS u1, max(u) FILTER (WHERE k IN ('M', '=', 'X') AND trf - rf >= r) AS u2,
  min(rf - 1) FILTER (WHERE k IN ('M', '=', 'X') AND rf - 1 >= l) AS moved, min(rd - 1) FILTER (WHERE k IN ('M', '=', 'X') AND rf - 1 >= l) AS cl, trd - max(rd) FILTER (WHERE k IN ('M', '=', 'X') AND trf - rf >= r) AS cr
  FROM cw JOIN tot ON tot.ord = cw.ord GROUP BY cw.ord, l, r, trf, trd, tu),
cg AS (SELECT *, u1 IS NULL OR u2 IS NULL OR u1 > u2 AS gone FROM cf),
cb AS (SELECT ord, string_agg(CAST(n AS VARCHAR) || k, '' ORDER BY i) AS body FROM (SELECT cw.ord, cw.i, cw.k, count(*) AS n FROM cw JOIN cg ON cg.ord = cw.ord
  WHERE NOT gone AND u >= CASE WHEN cg.l > 0 THEN u1 ELSE 1 END AND u <= CASE WHEN cg.r > 0 THEN u2 ELSE tu END GROUP BY 1, 2, 3) GROUP BY 1),
cc AS (SELECT cg.ord, CASE WHEN l = 0 THEN 0 ELSE coalesce(moved, trf) END AS moved, CASE WHEN gone THEN trd WHEN l = 0 THEN 0 ELSE cl END AS cl, CASE WHEN gone OR r = 0 THEN 0 ELSE cr END AS cr, coalesce(body, '') AS body
  FROM cg LEFT JOIN cb ON cb.ord = cg.ord)"""


def _clipped(kind, *more):
    edge = "CASE WHEN cc.{0} > 0 THEN CAST(cc.{0} AS VARCHAR) || '" + kind + "' ELSE '' END"
    columns = [f"CASE WHEN cc.ord IS NULL THEN a.{c} ELSE substr(a.{c}, CAST(cc.cl + 1 AS INT), CAST(greatest(length(a.seq) - cc.cl - cc.cr, 0) AS INT)) END AS {c}" for c in more]
    cigar = f"CASE WHEN cc.ord IS NULL THEN a.cigar ELSE {edge.format('cl')} || cc.body || {edge.format('cr')} END AS cigar"
    return _CLIPS + f" SELECT a.ord, CAST(a.pos + coalesce(cc.moved, 0) AS INT) AS pos, {', '.join([cigar, *columns])} FROM a LEFT JOIN cc ON cc.ord = a.ord"


SQL["ampliconclip"] = _clipped("S")
SQL["ampliconclip_hard"] = _clipped("H", "seq", "qual")
SQL["dict_md5"] = P + " SELECT name, length(sequence) AS length, md5(upper(sequence)) AS md5, '@SQ' || chr(9) || 'SN:' || name || chr(9) || 'LN:' || length(sequence) || chr(9) || 'M5:' || md5(upper(sequence)) || chr(9) || 'AS:asm' AS line FROM transcripts"
SQL["fasta_index"] = P + " SELECT name, length(sequence) AS length FROM transcripts"
SQL["faidx_regions"] = P + """ SELECT name, tid % 60 AS start, tid % 60 + 3 * size AS "end",
  substr(sequence, CAST(greatest(tid % 60, 1) AS INT), CAST(greatest(least(tid % 60 + 3 * size, length(sequence)) - greatest(tid % 60, 1) + 1, 0) AS INT)) AS sequence FROM transcripts"""
SQL["fqidx"] = P + " SELECT qname AS name, arg_max(seq, ord) AS seq, arg_max(qual, ord) AS qual FROM reads WHERE flag & 2304 = 0 AND qname IN (SELECT qname FROM reads WHERE flag & 2304 = 0 AND ord % 5 = 0) GROUP BY qname"
SQL["proper_pairs_by_contig"] = P + " SELECT c.name, count(*) AS n, CAST(sum(abs(r.tlen)) AS BIGINT) AS span FROM reads r JOIN contigs c ON c.tid = r.tid WHERE r.flag & 2304 = 0 AND r.flag & 4 = 0 AND r.flag & 2 = 2 GROUP BY 1"

# Mates in runs of one name: the names come again every 50 templates.
_RUNS = P.replace("reads AS (", "reads0 AS (", 1)
_RUN_READS = """, reads AS (SELECT ord, 'T' || CAST((ord // 4) % 50 AS VARCHAR) AS qname, flag, tid, pos, mapq, cigar, mtid, mpos, tlen, seq, qual, rg, rx FROM reads0),"""
SQL["fixmate_runs"] = _RUNS.replace(",\ncontigs AS (", _RUN_READS + "\ncontigs AS (", 1) + """, l0 AS (SELECT ord, CASE WHEN lag(qname) OVER (ORDER BY ord) IS NOT DISTINCT FROM qname THEN 0 ELSE 1 END AS new FROM reads),
l1 AS (SELECT ord, sum(new) OVER (ORDER BY ord) AS island FROM l0)""" + _FIX.replace("FROM a)", "FROM (SELECT a.* REPLACE (CAST(l1.island AS VARCHAR) AS qname) FROM a JOIN l1 ON l1.ord = a.ord))", 1) + " SELECT ord, flag, mtid, mpos, tlen FROM fm"
SQL["fixmate_tags"] = P + _FIX + " SELECT ord, concat_ws(' ', 'MC:Z:' || mc, 'ms:i:' || CAST(ms AS VARCHAR)) AS fields FROM fm"
SQL["calmd_tags"] = f"SELECT ord, concat_ws(' ', 'NM:i:' || CAST(nm AS VARCHAR), 'MD:Z:' || md) AS fields FROM ({SQL['calmd_md_nm']})"
FIELDS = "qname, flag, tid, pos, mapq, cigar, mtid, mpos, tlen, seq, qual, rg, rx"
SQL["bam_file"] = SQL["sam_file"] = P + f" SELECT {FIELDS}, mapq AS nm, nullif(cigar, '') AS xz, substr(rx, 1, 1) AS xa FROM reads"
SQL["sam_header"] = P + " SELECT CAST(tid AS INT) AS tid, name, CAST(length AS INT) AS length FROM contigs"
SQL["flagstat_file"] = SQL["flagstat"]
SQL["view_file"] = P + f" SELECT {FIELDS} FROM reads WHERE flag & 1 = 1 AND flag & 3844 = 0 AND mapq >= 20"
SQL["split_files"] = P + " SELECT coalesce(nullif(cigar, ''), 'unknown') AS value, count(*) AS n FROM reads GROUP BY 1"
SQL["fasta_file"] = P + " SELECT CAST(row_number() OVER (ORDER BY tid) - 1 AS INT) AS tid, name, sequence FROM transcripts"
SQL["fai_file"] = P + """, f AS (SELECT tid, name, CAST(length(sequence) AS BIGINT) AS length, CAST(2 + length(name) AS BIGINT) AS head FROM transcripts)
SELECT CAST(row_number() OVER (ORDER BY tid) - 1 AS INT) AS tid, name, length, CAST(sum(head + length + (length + 59) // 60) OVER (ORDER BY tid) - length - (length + 59) // 60 AS BIGINT) AS "offset",
  least(60, length) AS line_bases, least(60, length) + 1 AS line_width FROM f"""
SQL["fastq_files"] = _fastq(False, True) + " SELECT sink, '@' || name AS header, seq, qual FROM fq WHERE sink IN ('r1', 'r2', 'singleton')"
SQL["fqi_file"] = _fastq(False, True) + """, x AS (SELECT ord, name, length(name) AS h, length(seq) AS l, length(qual) AS q FROM fq WHERE sink = 'r1'),
y AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS n, sum(h + l + q + 6) OVER (ORDER BY ord) - (h + l + q + 6) AS first_ FROM x)
SELECT n, name, CAST(l AS BIGINT) AS length, CAST(first_ + h + 2 AS BIGINT) AS seq_offset, CAST(first_ + h + l + 5 AS BIGINT) AS qual_offset FROM y"""
SQL["bed_file"] = P + " SELECT row_number() OVER (ORDER BY iv) - 1 AS iv, CAST(tid AS INT) AS tid, name, CAST(bstart AS INT) AS bstart, CAST(bend AS INT) AS bend FROM bed"
SQL["idxstats_report"] = f"""SELECT CAST(coalesce(c.r_regionkey, 1099511627776) AS BIGINT) AS place, i.name || chr(9) || CAST(i.length AS VARCHAR) || chr(9) || CAST(i.mapped AS VARCHAR) || chr(9) || CAST(i.unmapped AS VARCHAR) AS text
FROM ({SQL["idxstats"]}) i LEFT JOIN region c ON replace(c.r_name, ' ', '_') = i.name"""
_LABELS = ", ".join(f"({k}, '{label}', CAST({c} AS VARCHAR))" for k, (label, c) in enumerate(SUMMARY.items()))
SQL["stats_report"] = P + f""", kept AS (SELECT * FROM reads WHERE flag & 2304 = 0), sn AS (SELECT *, (SELECT count(*) FROM kept WHERE mapq = 0) AS reads_mq0 FROM ({_SUMMARY}))
SELECT CAST(0 AS INT) AS section, CAST(k AS BIGINT) AS place, 'SN' || chr(9) || label || ':' || chr(9) || v AS text FROM sn, LATERAL (VALUES {_LABELS}, ({len(SUMMARY)}, 'average MAPQ', printf('%.2f', average_mapq))) AS t(k, label, v)
UNION ALL SELECT 1, read_length, 'RL' || chr(9) || CAST(read_length AS VARCHAR) || chr(9) || CAST(n AS VARCHAR) FROM ({SQL["stats_read_length"]})
UNION ALL SELECT 2, insert_size, 'IS' || chr(9) || CAST(insert_size AS VARCHAR) || chr(9) || CAST(n AS VARCHAR) FROM ({SQL["stats_insert_size"]})
UNION ALL SELECT 3, gc_percent, 'GCF' || chr(9) || CAST(gc_percent AS VARCHAR) || chr(9) || CAST(n AS VARCHAR) FROM ({SQL["stats_gc"]})
UNION ALL SELECT 4, mapq, 'MAPQ' || chr(9) || CAST(mapq AS VARCHAR) || chr(9) || CAST(n AS VARCHAR) FROM ({SQL["stats_mapq"]})"""
_DUPLICATES = ["read", "written", "excluded", "examined", "paired", "single", "duplicate_pair", "duplicate_single", "duplicate_total", "duplicate_optical"]
SQL["markdup_report"] = f"""SELECT CAST(k AS INT) AS place, text FROM ({SQL["markdup_stats"]}), LATERAL (VALUES (0, 'COMMAND: markdup'), {", ".join(f"({k + 1}, '{c.replace('_', ' ').upper()} ' || CAST({c} AS VARCHAR))" for k, c in enumerate(_DUPLICATES))}) AS t(k, text)"""

SQL["coverage_subset"] = f"SELECT name, numreads, covbases, meandepth FROM ({SQL['coverage'].replace('(mapq IS NULL OR mapq >= 10)', 'true')}) WHERE name IN ('ASIA', 'EUROPE')"
SQL["mpileup_capped"] = _pile(0) + """, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tid, p ORDER BY start, flag, qname, ord) AS place FROM pb) WHERE place <= 20),
r AS (SELECT k.*, c.name, coalesce(nullif(substr(f.sequence, k.p, 1), ''), 'N') AS ref FROM k JOIN contigs c ON c.tid = k.tid LEFT JOIN refseq f ON f.tid = k.tid)
SELECT name, CAST(p AS BIGINT) AS pos, ref, count(*) AS depth, string_agg(CASE WHEN upper(base) = upper(ref) THEN '.' ELSE upper(base) END, '' ORDER BY place) AS bases,
  string_agg(chr(CAST(least(q + 33, 126) AS INT)), '' ORDER BY place) AS quals FROM r GROUP BY name, p, ref"""
SQL["remap_contigs"] = P + " SELECT ord, CAST(4 - tid AS INT) AS tid, CAST(4 - mtid AS INT) AS mtid FROM reads"
SQL["quickcheck"] = "SELECT DISTINCT 'ok' AS state FROM orders"

SQL["bam_long_reads"] = P + """, r AS (SELECT k, qname, tid, pos, string_agg(translate(md5(k || '/' || i), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY i) AS seq
  FROM (SELECT *, unnest(range(pieces)) AS i FROM long_reads) GROUP BY k, qname, tid, pos)
SELECT qname, CAST(0 AS INT) AS flag, tid, pos, CAST(60 AS INT) AS mapq, length(seq) || 'M' AS cigar, CAST(length(seq) AS INT) AS bases, md5(seq) AS digest FROM r"""
SQL["view_bam_regions"] = P + f""" SELECT CAST(0 AS INT) AS region, {FIELDS} FROM a WHERE tid = 2 AND pos <= 700 AND endp >= 200
UNION ALL SELECT 1, {FIELDS} FROM a WHERE tid = 3 AND endp >= 1000
UNION ALL SELECT 2, {FIELDS} FROM a WHERE tid = 4 AND pos IS NOT NULL"""
SQL["view_bam_filter"] = P + f" SELECT {FIELDS} FROM reads WHERE tid = 2 AND pos BETWEEN 200 AND 700"
SQL["split_bam_files"] = P + """ SELECT 'all.' || coalesce(rg, 'unknown') || '.bam' AS name, count(*) AS n, CAST(sum(flag) AS BIGINT) AS flags, min(qname) AS low, max(qname) AS high,
  coalesce(rg, 'unknown') AS rg, CAST(1 AS BIGINT) AS groups FROM reads GROUP BY rg"""
SQL["dict_chunks"] = P + """ SELECT CAST(0 AS BIGINT) AS place, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted' AS line
UNION ALL SELECT CAST(row_number() OVER (ORDER BY tid) AS BIGINT), '@SQ' || chr(9) || 'SN:' || name || chr(9) || 'LN:' || length(sequence) || chr(9) || 'M5:' || md5(upper(sequence)) || chr(9) || 'AS:asm' FROM transcripts"""
SQL["faidx_file"] = SQL["faidx_regions"]
SQL["fqidx_file"] = _fastq(False, True) + """, x AS (SELECT name, seq, qual, row_number() OVER (ORDER BY ord) - 1 AS n FROM fq WHERE sink = 'r1')
SELECT name, arg_max(seq, n) AS seq, arg_max(qual, n) AS qual FROM x WHERE name IN (SELECT name FROM x WHERE n % 5 = 0) GROUP BY name"""
SQL["merge_programs"] = """SELECT 'p' || n_nationkey || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS id, n_name || '-' || k AS pn,
  CASE WHEN n_nationkey > 0 THEN 'p' || (n_nationkey - 1) || CASE WHEN k > 0 THEN '-' || k ELSE '' END END AS pp FROM nation CROSS JOIN range(3) AS t(k)"""
_WAY = "CASE WHEN (ord // 4) % 7 = 0 THEN ['fields', 'flag', 'pos', 'mapq', 'cigar', 'qual length', 'reference'][CAST((ord // 28) % 7 AS INT) + 1] ELSE 'ok' END"
SQL["sam_bad_lines"] = P + f" SELECT {_WAY} AS reason, count(*) AS n, count(*) FILTER (WHERE {_WAY} <> 'ok') AS lines FROM reads GROUP BY 1"
SQL["sam_without_bad_lines"] = P + f" SELECT {FIELDS} FROM reads WHERE (ord // 4) % 7 <> 0"
SQL["view_layout"] = SQL["view_multi_region"]

# Missing integers show as -1, as in the queries.
_SHOW = {
    **dict.fromkeys(["view_require", "view_exclude", "view_mapq", "view_region", "view_multi_region", "view_exclude_region", "head", "view_layout"], ("tid", "pos", "mapq")),
    **dict.fromkeys(["sort_coordinate", "sort_name", "merge", "merge_sorted", "sort_markdup"], ("tid", "pos")),
    "reheader": ("tid",),
    "remap_contigs": ("tid", "mtid"),
    "fixmate": ("mtid", "mpos", "ms"),
    "calmd_nm": ("nm",),
    "fixmate_runs": ("mtid", "mpos"),
    **dict.fromkeys(["bam_file", "sam_file"], ("tid", "pos", "mapq", "mtid", "mpos", "nm")),
    **dict.fromkeys(["view_file", "view_bam_regions", "view_bam_filter", "sam_without_bad_lines"], ("tid", "pos", "mapq", "mtid", "mpos")),
    "calmd_md_nm": ("nm",),
    "ampliconclip": ("pos",),
    "ampliconclip_hard": ("pos",),
}
for _name, _columns in _SHOW.items():
    SQL[_name] = f"SELECT * REPLACE ({', '.join(f'coalesce({c}, -1) AS {c}' for c in _columns)}) FROM ({SQL[_name]})"

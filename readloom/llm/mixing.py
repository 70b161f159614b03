"""Mixing sources to target weights by temperature, in DataFrame functions only.

Weights. With token shares p, the weight of a source is proportional to p ** t. The
exponent t in [0, 1] is the lowest, the flattest mix, at which the mix still meets
its limit: no source repeated more than `repetition` times on average, or an entropy
of at most `entropy` nats. It is bisected in one aggregate per `DEPTH` bisections
over the table of source sums, which stays distributed.

Realisation. `budget` tokens are dealt to the sources by weight (None: the budget at
which the source with the lowest ratio gets one whole pass, so nothing is dropped).
A source's quota is whole passes over its documents and a part of one more. Each
pass is a permutation by hash, cut into blocks of hash range of about `block` rows.
The running token sum is first taken over the sums of the blocks, then inside each
block, so a source that holds most rows is spread over many tasks. A part pass takes
the documents that start below what is left of the quota.

Defined results: a null source is a source of its own, written null; a null or
wordless text counts as one token, so that every row can be dealt; null ids and
repeated rows are dealt row by row, ties in hash broken by id and text; an empty
table gives an empty mix. `mixed` keeps all columns, under any names and of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readloom.llm.common import same, stash

DEPTH, ROUNDS = 5, 8


def tokens(text_col: str) -> Column:
    """Runs of anything but spaces, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t\n\r]+")), F.lit(0))).cast("long")


def source_sums(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """(source, docs, tokens) with one row per source."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("docs"), F.sum(tokens(text_col)).alias("tokens"))


def exponent(sums: DataFrame, *, budget: float | None, repetition: float | None, entropy: float | None) -> float:
    """The lowest exponent in [0, 1] that meets the limit, to 6 decimals upward."""
    total = sums.agg(F.sum("tokens")).first()[0]
    if not total or (repetition is None and entropy is None):
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def measured(ts: list[float]):
        """Per exponent: (sum of p^t, sum of p^t log p^t, highest and lowest p^(t-1))."""
        found = []
        for k, t in enumerate(ts):
            p = F.pow(share, F.lit(t))
            found += [F.sum(p).alias(f"a{k}"), F.sum(p * F.log(p)).alias(f"b{k}"), F.max(p / share).alias(f"c{k}"), F.min(p / share).alias(f"d{k}")]
        row = sums.agg(*found).first()
        return [tuple(row[f"{x}{k}"] for x in "abcd") for k in range(len(ts))]

    def good(m) -> bool:
        a, b, high, low = m
        if repetition is not None:
            # Passes over a source: weight * budget / tokens.
            passes = high / low if budget is None else high / a * budget / total
            return passes <= repetition * (1 + 1e-12)
        import math

        return math.log(a) - b / a <= entropy * (1 + 1e-12)

    lo, hi = 0.0, 1.0
    if good(measured([0.0])[0]):
        return 0.0
    for _ in range(ROUNDS):
        ts = [lo + (hi - lo) * k / (1 << DEPTH) for k in range(1, 1 << DEPTH)]
        ok = [good(m) for m in measured(ts)]
        k = ok.index(True) if True in ok else len(ts)
        lo, hi = ([lo] + ts)[k], (ts + [hi])[k]
        if hi - lo < 1e-9:
            break
    return min(1.0, -(-round(hi * 1e6, 3) // 1) / 1e6)


def quotas(sums: DataFrame, *, budget: float | None, repetition: float | None = 2.0, entropy: float | None = None) -> DataFrame:
    """(source, docs, tokens, weight, quota): the tokens to take from each source."""
    t = exponent(sums, budget=budget, repetition=repetition, entropy=entropy)
    part = F.pow(F.col("tokens").cast("double"), F.lit(t))
    norm, low = sums.agg(F.sum(part), F.max(F.col("tokens") / part)).first()
    weight = part / F.lit(norm or 1.0)
    given = F.lit(float((norm or 0) * (low or 0)) if budget is None else float(budget))
    quota = F.round(weight * given).cast("long")
    return sums.withColumn("weight", weight).withColumn("quota", F.greatest(quota, "tokens") if budget is None else quota)


def mix(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", budget: float | None = None, repetition: float | None = 2.0, entropy: float | None = None, block: int = 4096, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, pass): what the mix takes, one row per document and pass."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), tokens(text_col).alias("tokens"), F.xxhash64(F.col(text_col)).alias("version"))
    rows = stash(rows, "mix")
    sums = stash(rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), "sources")
    dealt = quotas(sums, budget=budget, repetition=repetition, entropy=entropy)
    dealt = dealt.select("source", "docs", F.col("tokens").alias("all"), "quota").withColumnRenamed("source", "of")
    joined = rows.join(dealt, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    passes = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("quota") / F.col("all")))
    each = joined.where("quota > 0").withColumn("pass", F.explode(passes))
    whole = each.where(F.col("pass") * F.col("all") <= F.col("quota"))
    part = each.where(F.col("pass") * F.col("all") > F.col("quota")).withColumn("left", F.col("quota") - (F.col("pass") - 1) * F.col("all"))
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("pass").cast("string"), F.lit(str(seed)))
    order = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")
    part = part.withColumn("order", order).withColumn("block", F.col("order") % F.ceil(F.col("docs") / block))
    key = ["source", "pass", "block"]
    blocks = part.groupBy(*key).agg(F.sum("tokens").alias("sum"))
    over = Window.partitionBy("source", "pass").orderBy("block")
    blocks = blocks.select(*(F.col(k).alias(f"b_{k}") for k in key), (F.sum("sum").over(over) - F.col("sum")).alias("before"))
    match = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("pass") == F.col("b_pass")) & (F.col("block") == F.col("b_block"))
    inside = Window.partitionBy(*key).orderBy("order", "doc_id", "version").rowsBetween(Window.unboundedPreceding, 0)
    # Only blocks that start below what is left are needed at all.
    placed = part.join(blocks, match).where("before < left").withColumn("start", F.col("before") + F.sum("tokens").over(inside) - F.col("tokens"))
    taken = placed.where("start < left")
    columns = ["doc_id", "source", "tokens", "version", "pass"]
    return whole.select(*columns).unionByName(taken.select(*columns))


def _has_map(kind: T.DataType) -> bool:
    inner = {T.ArrayType: lambda: [kind.elementType], T.StructType: lambda: [f.dataType for f in kind.fields]}.get(type(kind), list)()
    return isinstance(kind, T.MapType) or any(map(_has_map, inner))


def comparable(value: Column, kind: T.DataType) -> Column:
    """A value that hashes and sorts: maps, wherever they are in it, become sorted arrays of their entries."""
    if not _has_map(kind):
        return value
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), comparable(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(value), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, kind.elementType))
    fields = F.struct(*[comparable(value.getField(f.name), f.dataType).alias(f"f{k}") for k, f in enumerate(kind.fields)])
    return F.when(value.isNotNull(), fields)


def mixed(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = 4096, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns stay as they are, whatever their names.

    Rows that agree in id, source and text share what the mix takes of them evenly; what
    is left over goes to the first of them in the order of a hash of the whole row.
    """
    key = ["doc_id", "source", "version"]
    taken = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, block=block, **options).groupBy(*key).agg(F.count("*").alias("n"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("version"))
    copies = rows.groupBy(*key).agg(F.count("*").alias("copies"))
    often = stash(taken.alias("a").join(copies.alias("b"), same("a", "b", *key)).select("a.*", "copies"), "often")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n") / F.col("copies"))))
    whole = rows.alias("a").join(often.where("n >= copies").alias("b"), same("a", "b", *key)).select("row", times.alias("time")).select("row")
    rest = often.where("n % copies > 0").withColumns({"left": F.col("n") % F.col("copies"), "blocks": F.ceil(F.col("copies") / block)})
    if not rest.isEmpty():
        # Equal rows are one entry with a count; running counts go over blocks of a hash, then inside each.
        some = rows.alias("a").join(rest.alias("b"), same("a", "b", *key)).select("row", *[F.col(f"a.{k}").alias(k) for k in key], "left", "blocks")
        some = some.withColumn("as", comparable(F.col("row"), some.schema["row"].dataType))
        some = some.groupBy("as", *key, "left", "blocks").agg(F.count("*").alias("m"), F.first("row").alias("row"))
        some = some.withColumn("order", F.xxhash64("as")).withColumn("block", F.pmod("order", "blocks"))
        sums = some.groupBy(*key, "block").agg(F.sum("m").alias("sum"))
        sums = sums.withColumn("before", F.sum("sum").over(Window.partitionBy(*key).orderBy("block")) - F.col("sum")).drop("sum")
        inside = Window.partitionBy(*[f"a.{k}" for k in key], "a.block").orderBy("order", "as").rowsBetween(Window.unboundedPreceding, 0)
        placed = some.alias("a").join(sums.alias("b"), same("a", "b", *key, "block")).select("row", "left", "m", (F.col("before") + F.sum("m").over(inside) - F.col("m")).alias("start"))
        more = F.least("m", F.col("left") - F.col("start"))
        whole = whole.unionByName(placed.where("start < left").select("row", F.explode(F.sequence(F.lit(1).cast("long"), more)).alias("time")).select("row"))
    return whole.select("row.*")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(greatest(1, coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)) AS BIGINT) AS tokens FROM documents),
s AS (SELECT source, count(*) AS docs, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY source),
total AS (SELECT sum(tokens) AS t FROM s),
bisect AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
          max(power(s.tokens / total.t, (lo + hi) / 2) / (s.tokens / total.t)) / min(power(s.tokens / total.t, (lo + hi) / 2) / (s.tokens / total.t)) <= 2 AS ok
        FROM bisect, s, total WHERE i < 40 GROUP BY i, lo, hi)),
flat AS (SELECT max(total.t / s.tokens) / min(total.t / s.tokens) <= 2 AS ok FROM s, total),
e AS (SELECT CASE WHEN flat.ok THEN 0 ELSE least(1, ceil(round(hi * 1e6, 3)) / 1e6) END AS x FROM bisect, flat WHERE i = 40),
n AS (SELECT sum(power(s.tokens, x)) AS norm, max(s.tokens / power(s.tokens, x)) AS low FROM s, e),
q AS (SELECT source, docs, CAST(s.tokens AS BIGINT) AS total,
        greatest(CAST(round(power(s.tokens, x) / norm * (norm * low)) AS BIGINT), CAST(s.tokens AS BIGINT)) AS quota FROM s, e, n),
p AS (SELECT d.doc_id, d.source, d.tokens, q.docs, q.total, q.quota, pass FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source,
        unnest(range(1, CAST(ceil(q.quota / CAST(q.total AS DOUBLE)) AS BIGINT) + 1)) AS u(pass)),
o AS (SELECT *, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|' || CAST(pass AS VARCHAR) || '|0'), 1, 15) AS BIGINT) AS ord FROM p),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY source, pass ORDER BY ord % CAST(ceil(docs / 4096.0) AS BIGINT), ord, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS start FROM o)
SELECT doc_id, source, tokens, pass FROM r WHERE pass * total <= quota OR start < quota - (pass - 1) * total
"""

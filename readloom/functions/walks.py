"""Walks along a CIGAR as folds over its operations: mismatch text, edit distance, clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.cigar import cigar_ops, span

ALIGNED = ("M", "=", "X")
OPS = "array<struct<len:int,op:string>>"


def _state(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def mismatches(cigar: str = "cigar", seq: str = "seq", ref: str = "ref") -> Column:
    """(md, nm) of a read against the reference bases under it; null without bases or where read or reference runs out.

    A fold over the operations carries the places in reference and read, the matches
    since the last mismatch, the edits and the text so far. An aligned run whose bases
    equal the reference's adds its length; of others the places that differ are filtered
    out once, and the matches between them are differences of neighbouring places.
    """
    bases, under = F.upper(seq), F.upper(ref)
    names = ("r", "q", "run", "nm", "md", "ok")

    def changed(a, **new):
        return _state(**{k: new.get(k, a[k]) for k in names})

    def bound(value, f):
        """f of a value that is computed once."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def aligned(a, n):
        x, y = F.substring(under, a["r"] + 1, n), F.substring(bases, a["q"] + 1, n)
        here = {"r": a["r"] + n, "q": a["q"] + n}

        def places(z):
            return F.struct(z["x"].alias("x"), F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(z["x"], i) != F.get(z["y"], i)).alias("at"))

        def told(z):
            matches = lambda p, k: p - 1 - F.when(k == 0, -1 - a["run"]).otherwise(F.get(z["at"], k - 1))
            text = F.array_join(F.transform(z["at"], lambda p, k: F.concat(matches(p, k).cast("string"), F.get(z["x"], p))), "")
            return changed(a, run=n - 1 - F.element_at(z["at"], -1), nm=a["nm"] + F.size(z["at"]), md=F.concat(a["md"], text), **here)

        letters = F.struct(F.split(x, "").alias("x"), F.split(y, "").alias("y"))
        return F.when(x == y, changed(a, run=a["run"] + n, **here)).otherwise(bound(letters, lambda z: bound(places(z), told)))

    def step(a, o):
        n, op = o["len"], o["op"]
        inside = a["r"] + n <= F.length(under)
        gap = changed(a, r=a["r"] + n, run=0, nm=a["nm"] + n, md=F.concat(a["md"], a["run"].cast("string"), F.lit("^"), F.substring(under, a["r"] + 1, n)))
        lost = changed(a, ok=False)
        return (
            F.when(~a["ok"], a)
            .when(op.isin(*ALIGNED), F.when(inside & (a["q"] + n <= F.length(bases)), aligned(a, n)).otherwise(lost))
            .when(op == "I", changed(a, q=a["q"] + n, nm=a["nm"] + n))
            .when(op == "D", F.when(inside, gap).otherwise(lost))
            .when(op == "N", changed(a, r=a["r"] + n))
            .when(op == "S", changed(a, q=a["q"] + n))
            .otherwise(a)
        )

    def finish(a):
        return F.when(a["ok"], F.struct(F.concat(a["md"], a["run"].cast("string")).alias("md"), a["nm"].alias("nm")))

    return F.when((F.length(seq) > 0) & F.col(ref).isNotNull(), F.aggregate(cigar_ops(cigar), _state(r=0, q=0, run=0, nm=0, md="", ok=True), step, finish))


def _clip(ops: Column, reach: Column) -> Column:
    """(reach, cut, moved, done, out): the operations after `reach` reference bases from their start are clipped.

    cut counts the read's bases that go, moved the reference's. Clips, insertions and
    deletions at the new edge go as well.
    """

    def step(a, o):
        n, op = o["len"], o["op"]
        keep = _state(reach=a["reach"], cut=a["cut"], moved=a["moved"], done=True, out=F.concat(a["out"], F.array(o)))
        take = F.least(n, a["reach"])
        some = {"reach": a["reach"] - take, "cut": a["cut"] + take, "moved": a["moved"] + take}
        left = F.array(F.struct((n - take).alias("len"), op.alias("op")))
        part = F.when(take < n, _state(**some, done=True, out=F.concat(a["out"], left))).otherwise(_state(**some, done=False, out=a["out"]))
        return (
            F.when(a["done"], keep)
            .when(op.isin(*ALIGNED), F.when(a["reach"] > 0, part).otherwise(keep))
            .when(op.isin("D", "N"), _state(reach=a["reach"] - n, cut=a["cut"], moved=a["moved"] + n, done=False, out=a["out"]))
            .when(op.isin("I", "S"), _state(reach=a["reach"], cut=a["cut"] + n, moved=a["moved"], done=False, out=a["out"]))
            .otherwise(a)
        )

    none = F.array().cast(OPS)
    whole = _state(reach=0, cut=0, moved=0, done=True, out=ops)
    return F.when(reach > 0, F.aggregate(ops, _state(reach=reach, cut=0, moved=0, done=False, out=none), step)).otherwise(whole)


def clip(rows: DataFrame, *, left: str = "left", right: str = "right", cigar: str = "cigar", hard: bool = False) -> DataFrame:
    """rows with `_c` (cigar, moved, cut_left, cut_right) after clipping left and right reference bases.

    Clips count in bases of the read. Soft clips keep the length of the read. A read
    that is clipped away wholly becomes one clip.
    """
    names = rows.columns
    rows = rows.withColumn("_l", _clip(cigar_ops(cigar), F.col(left)))
    rows = rows.withColumn("_r", _clip(F.reverse("_l.out"), F.col(right)))
    rows = rows.withColumn("_some", F.exists("_r.out", lambda o: o["op"].isin(*ALIGNED)))
    rows = rows.withColumns(
        {
            "_cl": F.when(F.col("_some"), F.col("_l.cut")).otherwise(span(cigar, "MIS=X")),
            "_cr": F.when(F.col("_some"), F.col("_r.cut")).otherwise(0),
            "_hl": span(F.regexp_extract(cigar, r"^((\d+H)*)", 1), "H"),
            "_hr": span(F.regexp_extract(cigar, r"((\d+H)*)$", 1), "H"),
        }
    )

    def text(n, op):
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")

    def edge(changed, clipped, old, outer_first):
        if hard:
            made = text(old + clipped, "H")
        else:
            made = F.concat(*([text(old, "H"), text(clipped, "S")] if outer_first else [text(clipped, "S"), text(old, "H")]))
        return F.when(changed | ~F.col("_some"), made).otherwise("")

    body = F.array_join(F.transform(F.filter(F.reverse("_r.out"), lambda o: o["len"] > 0), lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    made = F.concat(edge(F.col(left) > 0, F.col("_cl"), F.col("_hl"), True), F.when(F.col("_some"), body).otherwise(""), edge(F.col(right) > 0, F.col("_cr"), F.col("_hr"), False))
    return rows.select(*names, F.struct(made.alias("cigar"), F.col("_l.moved").alias("moved"), F.col("_cl").alias("cut_left"), F.col("_cr").alias("cut_right")).alias("_c"))

"""Header side tables: unions with unique ids, program chains, the sort order line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.operators.filters import concatenate


def _renamed(tables: list[DataFrame]) -> DataFrame:
    """All rows of the inputs with `src` and `new`: the id, or where it was used before, the id with the next of -1, -2, ... that is no id of any input."""
    rows = concatenate(tables)
    place = F.row_number().over(Window.partitionBy("id").orderBy("src")) - 1
    rows = rows.withColumn("_k", place)
    ids = rows.select("id").distinct()
    more = rows.groupBy("id").agg((F.count("*") - 1).alias("more")).where("more > 0")
    taken = ids.where(F.col("id").rlike(r"-\d+$")).select(F.regexp_replace("id", r"-\d+$", "").alias("id")).groupBy("id").agg(F.count("*").alias("taken"))
    free = more.join(taken, "id", "left").select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("more") + F.coalesce("taken", F.lit(0)))).alias("n"))
    free = free.withColumn("new", F.concat_ws("-", "id", F.col("n").cast("string"))).join(ids.select(F.col("id").alias("new")), "new", "left_anti")
    free = free.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("n"))).select("id", "_k", "new")
    return rows.join(free, ["id", "_k"], "left").withColumn("new", F.coalesce("new", "id")).drop("_k")


def merge_ids(tables: list[DataFrame]) -> DataFrame:
    """All rows of the inputs' read-group tables; an id that was used before gets -1, -2, ...

    Records keep the group they name, so a renamed group is one that no record names.
    """
    columns = tables[0].columns
    return _renamed(tables).withColumn("id", F.col("new")).select(*columns)


def merge_programs(tables: list[DataFrame]) -> DataFrame:
    """All rows of the inputs' program tables; an id that was used before is renamed, and so are the links to it in its own input.

    A link to a program that its input lacks stays as it is.
    """
    columns, rows = tables[0].columns, _renamed(tables)
    names = rows.select("src", F.col("id").alias("pp"), F.col("new").alias("_pp"))
    rows = rows.join(names, ["src", "pp"], "left").withColumns({"id": F.col("new"), "pp": F.coalesce("_pp", "pp")})
    return rows.select(*columns)


def merge_comments(tables: list[DataFrame]) -> DataFrame:
    """(src, n, comment): all comments, those of the first input first."""
    return concatenate([t.select(F.monotonically_increasing_id().alias("n"), "comment") for t in tables]).select("src", "n", "comment")


def append_program(programs: DataFrame, name: str, version: str, command: str) -> DataFrame:
    """programs with one more, chained to each program that no other follows; its id is made unique.

    Tabs and line breaks in the command line become spaces. The table has one row per program.
    """
    known = [(r.id, r.pp) for r in programs.select("id", "pp").collect()]
    used, followed = {i for i, _ in known}, {p for _, p in known}
    leaves = [i for i, _ in known if i not in followed] or [None]
    made = []
    for leaf in leaves:
        new = name
        k = 0
        while new in used:
            k += 1
            new = f"{name}-{k}"
        used.add(new)
        made.append((new, name, version, " ".join(command.split()), leaf))
    return programs.unionByName(programs.sparkSession.createDataFrame(made, "id string, pn string, vn string, cl string, pp string"))


def sort_order_line(header: list[str], order: str) -> list[str]:
    """Header lines with the sort order set; a first line is made where there is none."""
    if not header or not header[0].startswith("@HD"):
        return [f"@HD\tVN:1.6\tSO:{order}", *header]
    fields = [f for f in header[0].split("\t") if not f.startswith("SO:")]
    return ["\t".join([*fields, f"SO:{order}"]), *header[1:]]


def same_contigs(tables: list[DataFrame]) -> bool:
    """Whether all contig tables hold the same names and lengths."""
    first = tables[0].select("name", "length")
    return all(first.exceptAll(t.select("name", "length")).isEmpty() and t.select("name", "length").exceptAll(first).isEmpty() for t in tables[1:])

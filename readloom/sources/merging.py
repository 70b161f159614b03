"""Merging inputs that are sorted already, without sorting them again.

write_sorted() leaves a folder of Parquet files that follow each other in the order of
the keys. merge_sorted() cuts the order into ranges with borders from a sample of all
inputs, so that a range takes about as many rows of all of them together. A task per range opens the
files of each input that reach into it, skips row groups that lie outside, and merges
the streams: of the batches at hand it takes the rows up to the lowest of their last
keys, which no later batch can come before, and puts them in order. Rows are shuffled
by nothing, and a task holds one batch per input.

Keys are those of operators.ordering, missing contigs and places last; equal keys come
in order of the inputs, and inside an input as they lie.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from readloom.operators.ordering import coordinate_keys, name_keys, numbered_parts
from readloom.session import stash
from readloom.sources.bam import located

COORDINATE = ("tid", "pos", "flag", "qname")
NAME = ("qname", "flag", "tid", "pos")
LAST = 2**31 - 1  # where a missing contig or place stands
BATCH = 8192


def write_sorted(reads: DataFrame, path: str, by_name: bool = False) -> None:
    """reads as Parquet files that follow each other in coordinate or name order."""
    keys = [*(name_keys() if by_name else coordinate_keys()), F.col("ord")]
    reads.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)


def _key(columns):
    """The key as one value that Spark and Python compare alike."""
    plain = {"tid": F.coalesce("tid", F.lit(LAST)), "pos": F.coalesce("pos", F.lit(LAST)), "flag": F.col("flag"), "qname": F.coalesce("qname", F.lit("")).cast("binary")}
    return F.struct(*[plain[c].alias(c) for c in columns])


@dataclass
class Slice(InputPartition):
    files: list[list[str]]  # of each input, in order
    low: tuple | None  # keys from here on
    high: tuple | None  # to before here


class Keyed:
    """A batch and the keys of its rows, which are looked at one by one by searches only."""

    def __init__(self, batch: pa.RecordBatch, columns):
        self.batch = batch
        self.parts = [batch.column(c) for c in columns]

    def __len__(self):
        return self.batch.num_rows

    def __getitem__(self, i: int) -> tuple:
        return tuple((b"" if pa.types.is_string(p.type) else LAST) if (v := p[i].as_py()) is None else v.encode() if isinstance(v, str) else v for p in self.parts)

    def slice(self, begin: int, end: int | None = None) -> Keyed:
        out = object.__new__(Keyed)
        out.batch = self.batch.slice(begin, None if end is None else end - begin)
        out.parts = [p.slice(begin, None if end is None else end - begin) for p in self.parts]
        return out


def stream(files: list[str], columns, low, high):
    """The batches of one input between two keys."""
    first = columns[0]
    for path in files:
        where, inner = located(path)
        with where.open_input_file(inner) as f:
            file = pq.ParquetFile(f)
            groups = [k for k in range(file.num_row_groups) if _inside(file.metadata.row_group(k), first, low, high)]
            for batch in file.iter_batches(BATCH, row_groups=groups):
                rows = Keyed(batch, columns)
                begin = 0 if low is None else bisect_left(rows, low)
                end = len(rows) if high is None else bisect_left(rows, high)
                if begin < end:
                    yield rows.slice(begin, end)
                if high is not None and end < len(rows):
                    return


def _inside(group, first: str, low, high) -> bool:
    """Whether a row group may hold rows between two keys, by the first part of them."""
    for k in range(group.num_columns):
        column = group.column(k)
        if column.path_in_schema == first:
            s = column.statistics
            if s is None or not s.has_min_max or s.null_count:
                return True
            plain = lambda x: x.encode() if isinstance(x, str) else x
            return (low is None or plain(s.max) >= low[0]) and (high is None or plain(s.min) <= high[0])
    return True


def merged(streams: list, columns):
    """Batches of all streams in the order of the keys, ties in the order of the streams."""
    held = {k: b for k, s in enumerate(streams) if (b := next(s, None)) is not None}
    while held:
        bound = min(b[len(b) - 1] for b in held.values())
        parts = []
        for k in sorted(held):
            b = held[k]
            n = bisect_right(b, bound)
            if n:
                parts.append((k, b.slice(0, n).batch))
            rest = b.slice(n) if n < len(b) else next(streams[k], None)
            # More rows of the bound's key may follow in this stream: those of later streams wait for them.
            while rest is not None and rest[0] == bound:
                n = bisect_right(rest, bound)
                parts.append((k, rest.slice(0, n).batch))
                rest = rest.slice(n) if n < len(rest) else next(streams[k], None)
            if rest is None:
                del held[k]
            else:
                held[k] = rest
        yield from ordered(parts, columns)


def ordered(parts: list[tuple[int, pa.RecordBatch]], columns):
    """Sorted parts as batches in one order; parts of one stream alone are in it already."""
    source = [pa.array([k], pa.int32()).take(pa.array([0] * b.num_rows)) for k, b in parts]
    batches = [b.append_column("src", s) for (_, b), s in zip(parts, source)]
    if len({k for k, _ in parts}) == 1:
        yield from batches
        return
    table = pa.Table.from_batches(batches)
    plain = {c: pc.fill_null(table[c], "" if pa.types.is_string(table[c].type) else LAST) for c in columns}
    place = pc.sort_indices(pa.table(plain), [(c, "ascending") for c in columns])  # stable
    yield from table.take(place).combine_chunks().to_batches(BATCH)


class MergeReader(DataSourceReader):
    def __init__(self, options):
        self.columns = NAME if options.get("by") == "name" else COORDINATE
        self.plan = options["plan"]

    def partitions(self):
        where, inner = located(self.plan)
        table = pq.read_table(inner, filesystem=where).to_pylist()
        key = lambda x: None if x is None else tuple(x[c] for c in self.columns)
        return [Slice(r["files"], key(r["low"]), key(r["high"])) for r in sorted(table, key=lambda r: r["range"])]

    def read(self, part: Slice):
        yield from merged([stream(f, self.columns, part.low, part.high) for f in part.files], self.columns)


class MergeSource(DataSource):
    @classmethod
    def name(cls):
        return "sorted_merge"

    def schema(self):
        raise ValueError("merge_sorted() names the schema")

    def reader(self, schema):
        return MergeReader(self.options)


def _plan(spark: SparkSession, paths: list[str], columns, ranges: int) -> str:
    """A table with the ranges and the files that reach into each; its path."""
    inputs = [spark.read.parquet(p).select(_key(columns).alias("key"), F.col("_metadata.file_path").alias("file")) for p in paths]
    files = None
    for k, rows in enumerate(inputs):
        own = rows.groupBy("file").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n")).withColumn("src", F.lit(k))
        files = own if files is None else files.unionByName(own)
    files = stash(files, "sorted_files")
    total = files.agg(F.sum("n")).first()[0] or 0
    sample = None
    for rows in inputs:
        part = rows.select("key").sample(min(1.0, 64 * ranges / max(1, total)), seed=1)
        sample = part if sample is None else sample.unionByName(part)
    # About 64 keys a range, at most 4 * 64 * ranges of them.
    keys = [r.key for r in sample.orderBy("key").limit(256 * ranges).collect()]
    borders = sorted({tuple(keys[len(keys) * k // ranges]) for k in range(1, ranges)}) if keys else []
    kind = files.schema["first"].dataType
    rows = [(k, low, high) for k, (low, high) in enumerate(zip([None, *borders], [*borders, None]))]
    cuts = spark.createDataFrame(rows, f"range int, low {kind.simpleString()}, high {kind.simpleString()}")
    # One row per range and file that reach into each other: the border files of neighbours, and no more.
    first = F.when(F.col("low").isNull(), True).otherwise(F.col("last") >= F.col("low"))
    last = F.when(F.col("high").isNull(), True).otherwise(F.col("first") < F.col("high"))
    meet = cuts.join(F.broadcast(files.select("src", "file", "first", "last")), first & last, "left")
    of = lambda k: F.filter("all", lambda x: x["src"] == k)
    by_input = [F.transform(F.array_sort(of(k)), lambda x: x["file"]) for k in range(len(paths))]
    plan = meet.groupBy("range", "low", "high").agg(F.collect_list(F.when(F.col("file").isNotNull(), F.struct("src", "first", "last", "file"))).alias("all"))
    plan = plan.select("range", "low", "high", F.array(*by_input).alias("files")).coalesce(1)
    return stash(plan, "merge_plan").inputFiles()[0]


def merge_sorted(spark: SparkSession, paths: list[str], *, by_name: bool = False, ranges: int | None = None, rank: str | None = None) -> DataFrame:
    """All rows of folders of write_sorted() in one order, with the number of their input in `src`.

    ranges defaults to one per shuffle partition; rank names a column for the place
    from 1, for which the rows are written once.
    """
    columns = NAME if by_name else COORDINATE
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.dataSource.register(MergeSource)
    schema = spark.read.parquet(paths[0]).schema.add("src", "integer")
    rows = spark.read.format("sorted_merge").schema(schema).options(plan=_plan(spark, paths, columns, ranges), by="name" if by_name else "coordinate").load()
    return numbered_parts(rows, rank) if rank else rows

"""Random access to text files by their indexes: tasks read the bytes that are asked for, by offset arithmetic.

The offsets of fasta_index() and fastq_index() count through the files of a folder in
order of path. What is asked for is joined with the index, dealt out and sorted by
offset, and each task seeks in the files; nothing else of them is read.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from readloom.sources.bam import located


def text_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder in order of path."""
    where, inner = located(path)
    info = where.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [(path, info.size)]
    found = [f for f in where.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found)


class Joined:
    """Files as one run of bytes; the last one read stays open."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files, self.base, self.read_bytes = files, [0], 0
        for _, size in files:
            self.base.append(self.base[-1] + size)
        self.open = None, None

    def read(self, begin: int, end: int) -> bytes:
        out = []
        while begin < end:
            k = bisect_right(self.base, begin) - 1
            while k < len(self.files) and self.base[k + 1] <= begin:
                k += 1  # an empty file
            if k >= len(self.files):
                raise ValueError(f"byte {begin} is behind the end of the files: the index is of others")
            if self.open[0] != k:
                self.close()
                where, inner = located(self.files[k][0])
                self.open = k, where.open_input_file(inner)
            self.open[1].seek(begin - self.base[k])
            part = self.open[1].read(min(end, self.base[k + 1]) - begin)
            out.append(part)
            begin += len(part)
            self.read_bytes += len(part)
        return b"".join(out)

    def close(self) -> None:
        if self.open[1]:
            self.open[1].close()
        self.open = None, None


def _fetched(rows: DataFrame, path: str, spans: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with a text column for each span of bytes [begin column, end column), without line ends, and `bytes_read`."""
    files = text_files(path)
    first = next(iter(spans.values()))[0]
    rows = rows.repartitionByRange(first).sortWithinPartitions(first)
    schema = StructType([*rows.schema.fields, *(StructField(name, StringType()) for name in spans), StructField("bytes_read", LongType())])

    def run(batches):
        joined = Joined(files)
        try:
            for batch in batches:
                texts, read = {name: [] for name in spans}, []
                edges = {name: (batch.column(a).to_pylist(), batch.column(b).to_pylist()) for name, (a, b) in spans.items()}
                for k in range(batch.num_rows):
                    before = joined.read_bytes
                    for name, (begin, end) in edges.items():
                        texts[name].append(joined.read(begin[k], end[k]).translate(None, b"\r\n").decode())
                    read.append(joined.read_bytes - before)
                yield pa.record_batch([*batch.columns, *(pa.array(t, pa.string()) for t in texts.values()), pa.array(read, pa.int64())], names=[*batch.schema.names, *texts, "bytes_read"])
        finally:
            joined.close()

    return rows.mapInArrow(run, schema)


def fasta_slices(path: str, index: DataFrame, regions: DataFrame) -> DataFrame:
    """(name, start, end, sequence, bytes_read) of regions (name, start, end), 1-based and clamped; names that the index lacks give no row."""
    low = F.greatest(F.col("start"), F.lit(1)) - 1
    high = F.least(F.col("end"), F.col("length"))
    at = lambda x: F.col("offset") + F.floor(x / F.col("line_bases")).cast("long") * F.col("line_width") + x % F.col("line_bases")
    some = (high > low) & (F.col("line_bases") > 0)
    rows = regions.join(index, "name").select("name", "start", "end", F.when(some, at(low)).otherwise(0).cast("long").alias("begin"), F.when(some, at(high - 1) + 1).otherwise(0).cast("long").alias("stop"))
    return _fetched(rows, path, {"sequence": ("begin", "stop")}).select("name", "start", "end", "sequence", "bytes_read")


def fastq_records(path: str, index: DataFrame, names: DataFrame) -> DataFrame:
    """(name, seq, qual, bytes_read) of the last record of each asked name."""
    last = F.max_by(F.struct("length", "seq_offset", "qual_offset"), "n").alias("r")
    rows = index.join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(last).select("name", "r.*")
    rows = rows.select("name", F.col("seq_offset").alias("s"), (F.col("seq_offset") + F.col("length")).alias("s_end"), F.col("qual_offset").alias("q"), (F.col("qual_offset") + F.col("length")).alias("q_end"))
    return _fetched(rows, path, {"seq": ("s", "s_end"), "qual": ("q", "q_end")}).select("name", "seq", "qual", "bytes_read")

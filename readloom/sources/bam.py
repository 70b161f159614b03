"""BAM files as a Python data source: spark.read.format("bam").load(path), df.write.format("bam").

A file is cut into ranges of compressed blocks. A task looks for the first record that
begins in its range, reads on until a chain of records proves it, however many blocks
that takes, and ends before the first record that begins behind the range. The writer
gives each task a complete file with header, and moves the files into place when the
job commits. Paths are plain ones or URIs of any file system that pyarrow opens (file,
hdfs, s3, gs); all workers must reach them.

write_index() adds a table with the reach of the records that begin in each 16 kb
of a contig, and where in the files they lie. Where it is there, a filter on tid and pos, or the
options of read_regions(), pick from it the ranges that are read at all.

A task takes one range, or of many ranges several; each range looks for its own records.

Options: read `split` (bytes of a range), `columns` (those of READS that are made, all by
default), `tid`, `begin`, `end` (only records that may overlap these places, 1-based; with
an index only their ranges are read); write `contigs` (JSON list of [name,
length] in order of tid) and `header` (header lines before the contigs).
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from readloom.functions.cigar import end_position
from readloom.functions.text import expand_pattern, parse_region
from readloom.schema import READS
from readloom.sources.records import FIXED, OPS, decode_batch, encode, encode_batch, heads, last_places  # noqa: F401

# Fixed values of the format.
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MAGIC = b"\x1f\x8b\x08\x04"
BLOCK = 65280
WINDOW_READ = 1 << 17  # bytes of a file that are read at once


def located(path: str):
    """(file system, path in it)."""
    if re.match(r"[a-z0-9]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def opened(path: str):
    where, inner = located(path)
    return where.open_input_file(inner)


def compress(data: bytes, level: int = 6) -> bytes:
    """The data as blocks, without the end marker."""
    out = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(struct.pack("<4BIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)


def block_size(head: bytes) -> int | None:
    """The size of the block that starts with these bytes, None if none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 6 <= min(12 + extra, len(head)):
        kind, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and n == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return None


def blocks(path: str, start: int = 0):
    """(offset, data) of the blocks from the first that starts at or after start."""
    with opened(path) as f:
        f.seek(start)
        window, at = f.read(WINDOW_READ), 0
        if start:
            while (at := window.find(MAGIC, at)) >= 0:
                size = block_size(window[at : at + 64])
                # A true start is followed by another block or the end of the file.
                if size and (at + size == len(window) or block_size(window[at + size : at + size + 64])):
                    start += at
                    break
                at += 1
            else:
                return
        while True:
            if len(window) - at < 1 << 16:  # a block has no more bytes
                window, at = window[at:] + f.read(WINDOW_READ), 0
            size = block_size(window[at : at + 64])
            if size is None:
                if at < len(window):
                    raise ValueError(f"{path}: no block at {start}")
                return
            raw = window[at : at + size]
            extra = struct.unpack_from("<H", raw, 10)[0]
            yield start, zlib.decompress(raw[12 + extra : -8], -15)
            start, at = start + size, at + size


def read_header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """(header text, contigs, bytes that the header takes)."""
    data, need = b"", 12
    for _, part in blocks(path):
        data += part
        if len(data) < need:
            continue
        if data[:4] != b"BAM\1":
            raise ValueError(f"{path}: not a BAM file")
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        try:
            n = struct.unpack_from("<i", data, at)[0]
            at, contigs = at + 4, []
            for _ in range(n):
                size = struct.unpack_from("<i", data, at)[0]
                contigs.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
                at += 8 + size
            if at <= len(data):
                return data[8 : 8 + struct.unpack_from("<i", data, 4)[0]].rstrip(b"\0").decode(), contigs, at
        except struct.error:
            pass
    raise ValueError(f"{path}: the header is cut off")


LARGEST = 1 << 28


def verdict(data: bytes | bytearray, at: int, contigs: int, ended: bool, chain: int = 3) -> bool | None:
    """Whether records start at this byte: `chain` of them, or as many as there are before the end of the file; None if more bytes must tell."""
    for _ in range(chain):
        if at == len(data) and ended:
            return True
        if at + FIXED > len(data):
            return False if ended else None
        size, tid, pos, name, _, _, ops, _, bases, mtid, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
        if not (-1 <= tid < contigs and -1 <= mtid < contigs and pos >= -1 and mpos >= -1):
            return False
        if name < 1 or bases < 0 or not 32 + name + 4 * ops + (bases + 1) // 2 + bases <= size <= LARGEST:
            return False
        text, cigar = at + FIXED, at + FIXED + name
        if any(not 33 <= c <= 126 for c in data[text : cigar - 1]) or data[cigar - 1 : cigar] not in (b"\0", b""):
            return False
        if cigar + 4 * ops <= len(data):
            if any(x & 15 >= len(OPS) for x in struct.unpack_from(f"<{ops}I", data, cigar)):
                return False
        at += 4 + size
        if at > len(data):
            return False if ended else None
    return True


def candidates(data: bytearray, start: int, contigs: int) -> list[int]:
    """Places from start on whose fixed part may be that of a record."""
    n = len(data) - FIXED + 1 - start
    if n <= 0:
        return []
    whole = bytes(data[start:])
    field = lambda offset, kind: np.ndarray((n,), kind, whole, offset, (1,))
    size, tid, pos, name, bases, mtid, mpos = (field(o, k) for o, k in ((0, "<i4"), (4, "<i4"), (8, "<i4"), (12, "u1"), (20, "<i4"), (24, "<i4"), (28, "<i4")))
    at = np.flatnonzero((size >= 33) & (size <= LARGEST))  # few pass: the rest is looked at there only
    tid, pos, name, bases, mtid, mpos = (x[at] for x in (tid, pos, name, bases, mtid, mpos))
    ok = (tid >= -1) & (tid < contigs) & (pos >= -1) & (mtid >= -1) & (mtid < contigs) & (mpos >= -1) & (name > 0) & (bases >= 0)
    return (at[ok] + start).tolist()


class Plain:
    """The decompressed bytes from some block on, and the block of each."""

    def __init__(self, path: str, start: int):
        self.source = blocks(path, start)
        self.data, self.starts, self.offsets, self.ended = bytearray(), [], [], False

    def more(self) -> bool:
        """Append one block; False at the end of the file."""
        offset, part = next(self.source, (None, None))
        self.ended = offset is None
        if not self.ended:
            self.starts.append(len(self.data))
            self.offsets.append(offset)
            self.data += part
        return not self.ended

    def place(self, at: int) -> tuple[int, int] | None:
        """(offset of the block, place in it) of a byte; None if its block is not read yet."""
        if at >= len(self.data):
            return None
        k = bisect_right(self.starts, at) - 1
        return self.offsets[k], at - self.starts[k]

    def drop(self, at: int) -> int:
        """Forget the blocks before that of a byte; the byte's new place."""
        k = bisect_right(self.starts, at) - 1
        if k > 0:
            cut = self.starts[k]
            del self.data[:cut]
            self.starts, self.offsets = [b - cut for b in self.starts[k:]], self.offsets[k:]
            at -= cut
        return at

    def first_record(self, end: int, contigs: int) -> int | None:
        """Where the first record begins that does so in a block before `end`; None if none does."""
        waiting, searched = deque(), 0
        while True:
            inside = not self.offsets or self.offsets[-1] < end
            if not (waiting or inside) or self.ended:
                return None
            self.more()
            if inside and not self.ended and self.offsets[-1] < end:
                waiting += candidates(self.data, searched, contigs)
                searched = max(searched, len(self.data) - FIXED + 1)
            elif inside:  # records may begin in the last bytes of the last block of the range
                last = self.starts[-1] if not self.ended else len(self.data)
                waiting += [k for k in candidates(self.data, searched, contigs) if k < last]
            while waiting:
                found = verdict(self.data, waiting[0], contigs, self.ended)
                if found is None:
                    break
                if found:
                    return waiting[0]
                waiting.popleft()

    def stretches(self, at: int, end: int, path: str, most: int = 4 << 20):
        """(bytes, starts in them, block offset << 16 | place) of records from a byte on that begin in a block before `end`, in stretches of about `most` bytes."""
        size_at = struct.Struct("<i").unpack_from
        while True:
            while not self.ended and len(self.data) - at < most and not (self.offsets and self.offsets[-1] >= end):
                self.more()
            limit = self.starts[bisect_left(self.offsets, end)] if self.offsets and self.offsets[-1] >= end else len(self.data)
            data, starts, need = bytes(self.data), [], at
            while at < limit:
                size = size_at(data, at)[0] if at + 4 <= len(data) else 0
                if size < FIXED - 4 and at + 4 <= len(data):
                    raise ValueError(f"{path}: no record at {self.place(at)}")
                need = at + 4 + size
                if not size or need > len(data):
                    break
                starts.append(at)
                at = need
            if starts:
                own = np.array(starts, np.int64)
                block = np.searchsorted(self.starts, own, "right") - 1
                yield data, own, (np.array(self.offsets, np.int64)[block] << 16) + own - np.array(self.starts, np.int64)[block]
            if at >= limit and (self.ended or self.offsets[-1] >= end):
                return
            need -= at
            at = self.drop(at)
            while len(self.data) < at + need:  # of a record that begins in what is read
                if not self.more():
                    raise ValueError(f"{path}: the record at {self.place(at)} is cut off")


@dataclass
class Range(InputPartition):
    path: str
    base: int  # bytes of the files before
    begin: int  # offset of a block, or where to look for one
    end: int  # records that begin in blocks from here on belong to others
    within: int | None = None  # place in the first block of a record that is known to begin there
    last: int | None = None  # the last record, as block offset << 16 | place, if it is known


@dataclass
class Task(InputPartition):
    ranges: list[Range]


SPLIT = 64 << 20  # bytes of a range, and of the ranges of a task
TASKS = 512  # up to so many ranges are tasks of their own


def dealt(ranges: list[Range], split: int) -> list[Task]:
    """The ranges in order, one a task; of more than TASKS of them several short ones share a task."""
    own = max(1, min(-(-len(ranges) // TASKS), SPLIT // split))
    return [Task(ranges[k : k + own]) for k in range(0, len(ranges), own)] or [Task([])]


def whole_files(files: list[tuple[str, int]], split: int) -> list[Range]:
    """The files (path, size) in ranges."""
    bases = np.cumsum([0] + [size for _, size in files]).tolist()
    return [Range(path, base, at, min(at + split, size)) for (path, size), base in zip(files, bases) for at in range(0, size, split)]


def stretches(part: Range, header: tuple[list, int] | None = None):
    """Plain.stretches() of the records of a range; header: contigs and bytes of the header, if they are known."""
    contigs, skip = header or read_header(part.path)[1:]
    plain = Plain(part.path, part.begin)
    if part.within is not None:
        at = part.within
    elif part.begin == 0:
        at = skip
    else:
        at = plain.first_record(part.end, len(contigs))
    for data, starts, own in plain.stretches(at, part.end, part.path) if at is not None else ():
        if part.last is not None and own[-1] > part.last:
            n = int(np.searchsorted(own, part.last, "right"))
            if n:
                yield data, starts[:n], own[:n]
            return
        yield data, starts, own


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the BAM files of a folder in order of name."""
    where, inner = located(path)
    info = where.get_file_info(inner)
    if info.type != fs.FileType.Directory:
        return [(path, info.size)]
    found = [f for f in where.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".bam") and not f.base_name.startswith(".")]
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found)


INDEX = "_index"
WINDOW = 14  # bits of a place in one window of the index
NEAR = 1 << 16  # compressed bytes that are read rather than skipped


@dataclass
class Places:
    """What filters and options say about the records that are asked for."""

    tid: int | None = None
    least: int = 1  # of pos
    most: int = 2**31 - 1
    reach: int = 1  # least last place

    @property
    def narrow(self) -> bool:
        return self.tid is not None


def picked(index: pa.Table, asked: Places) -> list[tuple[int, int, int]]:
    """(file number, first, last record) of the stretches of the files that may hold records that are asked for."""
    c = pa.compute
    at = lambda x: (max(x, 1) - 1) >> WINDOW
    keep = c.and_(c.equal(index["tid"], asked.tid), c.and_(c.greater_equal(index["bin"], at(asked.least)), c.less_equal(index["bin"], at(asked.most))))
    keep = c.and_(keep, c.greater_equal(index["reach"], asked.reach))
    rows = index.filter(keep)
    out: list[tuple[int, int, int]] = []
    for file, first, last in sorted(zip(*(rows[n].to_pylist() for n in ("file", "first", "last")))):
        if out and out[-1][0] == file and (first >> 16) <= (out[-1][2] >> 16) + NEAR:
            out[-1] = (file, out[-1][1], max(last, out[-1][2]))
        else:
            out.append((file, first, last))
    return out


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.files = sorted(f for x in options["path"].split(",") for f in _listed(x))
        self.split = int(options.get("split", SPLIT))
        self.columns = listed_columns(options)
        tid, begin, end = (options.get(k) for k in ("tid", "begin", "end"))
        self.asked = Places(None if tid is None else int(tid), 1, int(end or 2**31 - 1), int(begin or 1))
        # An index is that of one folder as it was written.
        self.index = f"{options['path'].rstrip('/')}/{INDEX}" if "," not in options["path"] else None

    def pushFilters(self, filters):
        """Bounds on tid and pos choose ranges; Spark filters the rows, so all filters stay."""
        bound = {GreaterThan: ("least", 1), GreaterThanOrEqual: ("least", 0), LessThan: ("most", -1), LessThanOrEqual: ("most", 0)}
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("tid",) and self.asked.tid is None:
                self.asked.tid = f.value
            if getattr(f, "attribute", None) == ("pos",):
                for side, step in [bound[type(f)]] if type(f) in bound else [("least", 0), ("most", 0)] if isinstance(f, EqualTo) else []:
                    held, value = getattr(self.asked, side), f.value + step
                    setattr(self.asked, side, max(held, value) if side == "least" else min(held, value))
            yield f

    def partitions(self):
        bases = np.cumsum([0] + [size for _, size in self.files]).tolist()
        if self.asked.narrow and self.index and located(self.index)[0].get_file_info(located(self.index)[1]).type == fs.FileType.Directory:
            return dealt(self._indexed(bases), self.split)
        return dealt(whole_files(self.files, self.split), self.split)

    def _indexed(self, bases: list[int]) -> list[Range]:
        import pyarrow.parquet as pq

        where, inner = located(self.index)
        names = [f.path for f in where.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".parquet")]
        # Row groups are sorted by contig and window: the rest of the index is not read.
        tables = [pq.read_table(n, filesystem=where, filters=[("tid", "=", self.asked.tid)]) for n in names]
        index, out = pa.concat_tables(tables) if tables else None, []
        if index and any(x != bases[-1] for x in pa.compute.unique(index["bytes"]).to_pylist()):
            raise ValueError(f"{self.index}: the index is of other files than there are; write_index() again")
        for file, first, last in picked(index, self.asked) if index else []:
            path, size = self.files[file]
            begin, stop, within = first >> 16, last >> 16, first & 0xFFFF
            for at in range(begin, stop + 1, self.split):
                end = min(at + self.split, stop + 1)
                out.append(Range(path, bases[file], at, end, within if at == begin else None, last))
        return out

    def read(self, task: Task):
        headers: dict[str, tuple[list, int]] = {}
        for part in task.ranges:
            if part.path not in headers:
                headers[part.path] = read_header(part.path)[1:]
            for data, starts, own in stretches(part, headers[part.path]):
                for at in range(0, len(starts), 4096):
                    keep = self.wanted(data, starts[at : at + 4096])
                    if keep.any():
                        # Unique and in file order: the block's place in all files (up to 2 ** 47 bytes), the place in the block.
                        ords = own[at : at + 4096][keep] + (part.base << 16)
                        yield decode_batch(data, starts[at : at + 4096][keep], ords, self.columns)

    def wanted(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """Whether the filters may let each record through; where no contig is asked for, all of them are let through."""
        asked = self.asked
        if not asked.narrow:
            return np.ones(len(starts), bool)
        head = heads(data, starts)
        keep = (head["tid"] == asked.tid) & (head["pos"] < asked.most)
        if asked.least > 1:
            keep &= head["pos"] >= asked.least - 1
        if asked.reach > 1 and keep.any():
            keep[keep] = last_places(data, head[keep], starts[keep]) >= asked.reach
        return keep


def listed_columns(options) -> list[str]:
    """The columns that the option `columns` lists, in the order of READS."""
    names = options.get("columns", "").replace(",", " ").split()
    if unknown := set(names) - set(READS.names):
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    return [c for c in READS.names if not names or c in names]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # temporary name, name in its place


class BamWriter(DataSourceArrowWriter):
    """A file per task; with the option `pattern` one per task and value of the column `split`, in a folder of that value's own name."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.header = options.get("header", "@HD\tVN:1.6\tSO:unsorted\n")
        self.contigs = [(name, int(length)) for name, length in json.loads(options.get("contigs", "[]"))]
        self.pattern, self.stem = options.get("pattern"), options.get("stem", "")
        self.job = uuid.uuid4().hex[:12]
        where, inner = located(self.path)
        where.create_dir(inner, recursive=True)

    def folder(self, value: str | None) -> str:
        """Where rows of a value go; a value cannot lead out of the folder."""
        return expand_pattern(self.pattern, self.stem, value).replace("/", "_").lstrip(".") or "_"

    def write(self, batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}-{self.job}.bam"
        if not self.pattern:
            return Written([self._file(batches, name)])
        # Rows come sorted by value: one file is open at a time.
        runs = ((self.folder(value), own) for batch in batches for value, own in _runs(batch, "split"))
        return Written([self._file((own for _, own in part), f"{folder}/{name}") for folder, part in groupby(runs, lambda x: x[0])])

    def _file(self, batches, name: str) -> tuple[str, str]:
        temporary = f".{posixpath.basename(name)}-{uuid.uuid4().hex}"
        lines = "" if "@SQ\t" in self.header else "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in self.contigs)
        text = (self.header + lines).encode()
        head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.contigs))
        head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in self.contigs)
        where, inner = located(self.path)
        with where.open_output_stream(posixpath.join(inner, temporary)) as f:
            f.write(compress(head))
            rest = b""
            for part in (x for batch in batches for x in encode_batch(batch)):
                part = rest + part
                whole = len(part) - len(part) % BLOCK
                for at in range(0, whole, 16 * BLOCK):
                    f.write(compress(part[at : min(at + 16 * BLOCK, whole)]))
                rest = part[whole:]
            f.write(compress(rest) + EOF_BLOCK)
        return temporary, name

    def commit(self, messages):
        where, inner = located(self.path)
        files = [x for m in messages if m for x in m.files]
        for folder in {posixpath.dirname(name) for _, name in files} - {""}:
            where.create_dir(posixpath.join(inner, folder), recursive=True)
        for temporary, name in files:
            where.move(posixpath.join(inner, temporary), posixpath.join(inner, name))

    def abort(self, messages):
        where, inner = located(self.path)
        for temporary, _ in [x for m in messages if m for x in m.files]:
            if where.get_file_info(posixpath.join(inner, temporary)).type == fs.FileType.File:
                where.delete_file(posixpath.join(inner, temporary))


def _runs(batch: pa.RecordBatch, column: str):
    """(value, rows) of each stretch of rows with one value."""
    runs, at = pa.compute.run_end_encode(batch.column(column)), 0
    for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
        yield value, batch.slice(at, end - at)
        at = end


class BamDataSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return StructType([READS[c] for c in listed_columns(self.options)])

    def reader(self, schema):
        return BamReader(self.options)

    def writer(self, schema, overwrite):
        return BamWriter(self.options)


def register(spark) -> None:
    """Make format("bam") known to the session, and let filters reach it (Spark's own switch for that is off by default)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamDataSource)


def write_index(spark: SparkSession, path: str) -> None:
    """Index the BAM files of a folder, in a folder in it: per file, contig and window of 2 ** WINDOW places the first and last
    record that begin there, as block offset << 16 | place, and how far any of them reaches. Files sorted by place make it sharp;
    of others it is right, but its stretches overlap.
    """
    files = _listed(path)
    parts = [(k, part.begin, part.end) for k, f in enumerate(files) for part in whole_files([f], SPLIT)]
    paths, kind = [f for f, _ in files], "file int, tid int, bin int, first bigint, last bigint, reach bigint, n bigint"

    def run(batches):
        for batch in batches:
            for file, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                for data, starts, own in stretches(Range(paths[file], 0, begin, end)):
                    yield _windows(file, data, starts, own)

    # One range a task: a row of a few bytes stands for 64 MB.
    ranges = spark.createDataFrame(parts, "file int, at bigint, until bigint").repartition(max(1, len(parts)))
    table = ranges.mapInArrow(run, kind).groupBy("file", "tid", "bin")
    table = table.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("reach").cast("int").alias("reach"), F.sum("n").alias("n"))
    table = table.withColumn("bytes", F.lit(sum(size for _, size in files)).cast("long"))
    table.orderBy("tid", "bin", "file").write.mode("overwrite").parquet(f"{path.rstrip('/')}/{INDEX}")


def _windows(file: int, data: bytes, starts: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
    """The index rows of the placed records of a stretch."""
    head = heads(data, starts)
    placed = (head["tid"] >= 0) & (head["pos"] >= 0)
    head, starts, own = head[placed], starts[placed], own[placed]
    table = pa.table({"tid": head["tid"], "bin": head["pos"] >> WINDOW, "own": own, "reach": last_places(data, head, starts)})
    out = table.group_by(["tid", "bin"]).aggregate([("own", "min"), ("own", "max"), ("reach", "max"), ("own", "count")])
    made = [pa.array(np.full(len(out), file, np.int32)), *(out[c].combine_chunks() for c in ("tid", "bin", "own_min", "own_max", "reach_max", "own_count"))]
    return pa.record_batch(made, ["file", "tid", "bin", "first", "last", "reach", "n"])


def read_regions(spark: SparkSession, path: str, contigs: DataFrame, regions: list[str], **options) -> DataFrame:
    """Rows of indexed BAM files that overlap each region, once per region, with the region's number in `region`; only ranges that may hold some are read."""
    named = [parse_region(r) for r in regions]
    tids = {r.name: r.tid for r in contigs.where(F.col("name").isin(*{n for n, _, _ in named})).select("name", "tid").collect()}  # one row per region asked
    out = spark.createDataFrame([], StructType([READS[c] for c in listed_columns(options)])).withColumn("region", F.lit(0))
    for k, (name, begin, end) in enumerate(named):
        if name not in tids:
            continue
        begin, end = begin or 1, 2**31 - 1 if end is None else end
        rows = spark.read.format("bam").options(**options, tid=tids[name], begin=begin, end=end).load(path)
        part = rows.where((F.col("tid") == tids[name]) & (F.col("pos") <= end) & (end_position() >= begin))
        out = out.unionByName(part.withColumn("region", F.lit(k)))
    return out


def contig_option(contigs: DataFrame) -> str:
    """The writer's option `contigs`: a header names its contigs in the driver's memory anyway."""
    return json.dumps([(r.name, int(r.length)) for r in contigs.orderBy("tid").select("name", "length").collect()])


def quickcheck(path: str, unrecognized_ok: bool = False) -> str | None:
    """What is wrong with a file: None if its magic, header and end marker are in place."""
    where, inner = located(path)
    size = where.get_file_info(inner).size or 0
    if size < 2:
        return "too short"
    with opened(path) as f:
        head = f.read(4)
        if head[:2] != b"\x1f\x8b":
            return None if unrecognized_ok else "not compressed in blocks"
        f.seek(max(0, size - len(EOF_BLOCK)))
        tail = f.read()
    try:
        read_header(path)
    except (ValueError, zlib.error, struct.error) as e:
        return str(e)
    return None if tail == EOF_BLOCK else "no end marker"


def quickcheck_files(spark: SparkSession, paths: list[str], unrecognized_ok: bool = False) -> DataFrame:
    """(path, problem) of many files, looked at by the workers."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column("path").to_pylist()
            yield pa.record_batch({"path": pa.array(own, pa.string()), "problem": pa.array([quickcheck(p, unrecognized_ok) for p in own], pa.string())})

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, "path string, problem string")


def write_split(reads: DataFrame, path: str, contigs: DataFrame, *, tag: str = "RG", pattern: str = "%*_%!.bam", stem: str = "reads", header: str | None = None) -> None:
    """One folder of BAM files per value of a text tag, "unknown" where it is missing, named by pattern: %* is the stem, %! the value.

    Rows of a value keep their order; a frequent value is dealt to several tasks, whose
    files follow each other. Every file has the header.
    """
    from readloom.operators.counts import tag_value

    register(reads.sparkSession)
    columns = [F.col(f.name).cast(f.dataType) for f in READS if f.name in reads.columns]
    rows = reads.select(*columns, tag_value(reads, tag).alias("split")).repartitionByRange("split", "ord").sortWithinPartitions("split", "ord")
    options = {"contigs": contig_option(contigs), "pattern": pattern, "stem": stem} | ({"header": header} if header else {})
    rows.write.format("bam").options(**options).mode("append").save(path)


def split_folders(path: str) -> list[str]:
    """The folders of write_split(), in order of name."""
    where, inner = located(path)
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in where.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.Directory)


def detect_format(path: str) -> str:
    """bam, cram or sam, by the first bytes."""
    with opened(path) as f:
        head = f.read(4)
    return "cram" if head == b"CRAM" else "bam" if head[:2] == b"\x1f\x8b" else "sam"

"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. A bundle is its frames, a
skippable frame with the record index (identifier, frame, offset and length inside
the decompressed frame), and a skippable frame with the seek table (compressed and
decompressed size of each frame), whose footer ends the bundle. A reader finds the
footer, then the table, then one frame: single records need one frame's bytes.
record_index() is the same for all bundles at once, and fetch() reads records by it.

Bundles are binary rows of a Parquet table that Spark commits per task, so writers
need no shared local disk; the data of a row is a complete .warc.zst file.

Records with equal payloads of at least `revisit_bytes` bytes are stored once: the
one with the largest id is a response, the others are revisits of it.

Defined results: a null payload is empty; equal ids are separate records (of equal
payloads with that largest id, all are responses); a null id is never referred to
unless it is alone, and sorts below all others; an empty table gives no bundle;
other columns are left out.
"""

from __future__ import annotations

import base64
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import pieces, stash

# Fixed values of the seekable format: skippable frame magics and the footer magic.
SEEK_MAGIC, INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
FRAME, BUNDLE = 256 << 10, 8 << 20


def record_id(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def record(key, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: a response has the HTTP head and the payload as its block, a revisit the HTTP head alone."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key)}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else quote(c) for c in url))
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Packs records into one bundle."""

    def __init__(self, level: int = 3):
        self.level = level
        self.frames, self.table, self.index = [], [], []
        self.open, self.size = [], 0
        self.bytes = 0

    def add(self, key: str, data: bytes):
        name = key.encode()
        self.index.append(struct.pack("<IIII", len(self.frames), self.size, len(data), len(name)) + name)
        self.open.append(data)
        self.size += len(data)
        if self.size >= FRAME:
            self._frame()

    def _frame(self):
        packed = zstandard.ZstdCompressor(level=self.level).compress(b"".join(self.open))
        self.frames.append(packed)
        self.table.append(struct.pack("<II", len(packed), self.size))
        self.bytes += len(packed)
        self.open, self.size = [], 0

    def close(self) -> bytes:
        if self.open:
            self._frame()
        index = zstandard.ZstdCompressor(level=self.level).compress(b"".join(self.index))
        table = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0, FOOTER_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", INDEX_MAGIC, len(index)), index, struct.pack("<II", SEEK_MAGIC, len(table)), table])


class BundleReader:
    """Random access to the records of a bundle."""

    def __init__(self, data: bytes):
        count, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table")
        at = len(data) - 9 - 8 * count
        sizes = [struct.unpack_from("<II", data, at + 8 * k) for k in range(count)]
        self.data, self.places, place = data, [], 0
        for packed, plain in sizes:
            self.places.append((place, packed, plain))
            place += packed
        magic, size = struct.unpack_from("<II", data, place)
        if magic != INDEX_MAGIC:
            raise ValueError("no record index")
        raw = zstandard.ZstdDecompressor().decompress(data[place + 8 : place + 8 + size], max_output_size=1 << 31) if size else b""
        self.index, at = [], 0
        while at < len(raw):
            frame, offset, length, n = struct.unpack_from("<IIII", raw, at)
            self.index.append((raw[at + 16 : at + 16 + n].decode(), frame, offset, length))
            at += 16 + n
        self.held = (None, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            place, packed, plain = self.places[k]
            self.held = (k, zstandard.ZstdDecompressor().decompress(self.data[place : place + packed], max_output_size=plain))
        return self.held[1]

    def records(self):
        """(identifier, headers, block) in order."""
        for key, frame, offset, length in self.index:
            yield key, *parse(self.frame(frame)[offset : offset + length])

    def get(self, key: str):
        """(headers, block) of one record, from its frame alone."""
        for k, frame, offset, length in self.index:
            if k == key:
                return parse(self.frame(frame)[offset : offset + length])
        raise KeyError(key)


def parse(data: bytes) -> tuple[dict, bytes]:
    """The headers of a record, and the payload that follows the HTTP head of its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


def write_bundles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """Bundles (bundle, data, n_records) of all rows; bundle is the number of a bundle."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")
    ).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    last = rows.where(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = rows.join(last, ["digest", "size"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    plain = known.withColumn("revisit", revisit)
    plain = plain.withColumn("payload", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")))

    def run(batches):
        out, n, bundle = BundleWriter(), 0, TaskContext.get().partitionId() << 32

        def closed():
            return pa.record_batch({"bundle": pa.array([bundle], pa.int64()), "data": pa.array([out.close()], pa.binary()), "n_records": pa.array([n], pa.int64())})

        for batch in batches:
            for part in pieces(batch, "payload"):
                for r in part.to_pylist():
                    digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                    out.add(record_id(r["key"]), record(r["key"], r["url"], r["payload"], r["size"], digest, r["last"], r["revisit"]))
                    n += 1
                    if out.bytes >= BUNDLE:
                        yield closed()
                        out, n, bundle = BundleWriter(), 0, bundle + 1
        if n:
            yield closed()

    return plain.mapInArrow(run, "bundle long, data binary, n_records long")


def record_index(bundles: DataFrame) -> DataFrame:
    """(record_id, bundle, frame, offset, length): where each record of all bundles is, the offset inside its decompressed frame."""

    def run(batches):
        for batch in batches:
            for bundle, data in zip(batch.column("bundle").to_pylist(), batch.column("data").to_pylist()):
                rows = BundleReader(data).index
                names, kinds = ["record_id", "frame", "offset", "length"], [pa.string(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.record_batch([*columns, pa.array([bundle] * len(rows), pa.int64())], names=[*names, "bundle"])

    return bundles.select("bundle", "data").mapInArrow(run, "record_id string, frame long, offset long, length long, bundle long")


def fetch(bundles: DataFrame, index: DataFrame, ids: DataFrame) -> DataFrame:
    """(page_id, headers, payload) of the records of some page_ids: only their bundles are joined, only their frames decompressed."""
    wanted = index.join(ids.select(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")).alias("record_id")).distinct(), "record_id")
    places = wanted.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "offset", "length", "record_id"))).alias("places"))

    def run(batches):
        for batch in batches:
            for data, own in zip(batch.column("data").to_pylist(), batch.column("places").to_pylist()):
                reader = BundleReader(data)
                found = [(_number(p["record_id"]), *parse(reader.frame(p["frame"])[p["offset"] : p["offset"] + p["length"]])) for p in own]
                yield pa.record_batch({"page_id": pa.array([f[0] for f in found], pa.int64()), "headers": pa.array([list(f[1].items()) for f in found], pa.map_(pa.string(), pa.string())), "payload": pa.array([f[2] for f in found], pa.binary())})

    return bundles.select("bundle", "data").join(places, "bundle").select("data", "places").mapInArrow(run, "page_id long, headers map<string,string>, payload binary")


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def read_bundles(bundles: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, frame, offset, length, block) of every record."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                reader, out, size = BundleReader(data), [], 0
                places = iter(reader.index)
                for key, h, block in reader.records():
                    _, frame, offset, length = next(places)
                    out.append((_number(key), h.get("WARC-Target-URI"), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], _number(h.get("WARC-Refers-To")), frame, offset, length, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(out)
                        out, size = [], 0
                if out:
                    yield batch_of(out)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "frame", "offset", "length", "block"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return bundles.select("data").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, frame long, offset long, length long, block binary")


def archive_report(pages: DataFrame, **options) -> DataFrame:
    """Write the bundles to the shared folder, read them back, and return the digest of each record."""
    records = read_bundles(stash(write_bundles(pages, **options), "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
h AS (SELECT page_id, x, sha1(x) AS d, max(page_id) OVER (PARTITION BY x) AS last_, count(*) OVER (PARTITION BY x) AS n FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + ((CAST('0x' || substr(d, CAST(5 * (k // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS digest FROM h)
SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last_ THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_ THEN last_ END AS refers_to FROM b
"""

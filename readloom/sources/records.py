"""BAM records as bytes: one record or one row at a time, and whole batches in numpy and Arrow kernels.

encode() and decode() say what a record is. encode_batch() and decode_batch() give the
same for many: cigars and tags are translated once per distinct value, the rest goes
through kernels over the joined bytes. Batches that the kernels don't cover (text that is
not ASCII, numbers out of the format's bounds) go row by row, with the same errors.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import Row
from pyspark.sql.pandas.types import to_arrow_schema

from readloom.schema import READS

# Fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
FIXED = 36  # bytes of a record before its name

# Fixed values of the format: the number kinds of tags.
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def shown(x) -> str:
    return str(x) if isinstance(x, int) else f"{x:.9g}"


def tag_value(data: bytes, at: int, kind: str) -> tuple[str, int]:
    """The value of a tag as text, and where it ends."""
    if kind in "ZH":
        stop = data.index(b"\0", at)
        return data[at:stop].decode(), stop + 1
    if kind == "A":
        return chr(data[at]), at + 1
    if kind == "B":
        inner, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
        form = f"<{n}{NUMBERS[inner][1]}"
        return ",".join([inner, *map(shown, struct.unpack_from(form, data, at + 5))]), at + 5 + struct.calcsize(form)
    return shown(struct.unpack_from(NUMBERS[kind], data, at)[0]), at + struct.calcsize(NUMBERS[kind])


def tag_bytes(name: str, kind: str, value: str) -> bytes:
    """A tag as bytes; whole numbers take 32 bits."""
    head = name.encode()
    if kind in "ZH":
        return head + kind.encode() + value.encode() + b"\0"
    if kind == "A":
        return head + b"A" + value[:1].encode()
    if kind == "B":
        inner, *numbers = value.split(",")
        number = float if inner == "f" else int
        return head + b"B" + inner.encode() + struct.pack(f"<i{len(numbers)}{NUMBERS[inner][1]}", len(numbers), *map(number, numbers))
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    return head + (b"I" if int(value) > 0x7FFFFFFF else b"i") + struct.pack("<I" if int(value) > 0x7FFFFFFF else "<i", int(value))


def read_tags(data: bytes) -> dict[str, tuple[str, str]]:
    """Name -> (type, value) of the tags of a record; the first of one name counts."""
    tags, at = {}, 0
    while at < len(data):
        key, kind = data[at : at + 2].decode(), chr(data[at + 2])
        value, at = tag_value(data, at + 3, kind)
        tags.setdefault(key, ("i" if kind in "cCsSI" else kind, value))
    return tags


PAIRS = [BASES[k >> 4] + BASES[k & 15] for k in range(256)]
SHOWN_QUALITY = bytes(min(q, 93) + 33 for q in range(256))


def decode(data: bytes) -> tuple:
    """The columns of READS but ord, of a record without its size."""
    at, size = 0, len(data)
    tid, pos, name, mapq, _, ops, flag, bases, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", data, at)
    end, at = at + size, at + 32
    qname = data[at : at + name - 1].decode()
    at += name
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{ops}I", data, at))
    at += 4 * ops
    seq = "".join(map(PAIRS.__getitem__, data[at : at + (bases + 1) // 2]))[:bases]
    at += (bases + 1) // 2
    qual = data[at : at + bases]
    qual = "" if not qual or qual[0] == 255 else qual.translate(SHOWN_QUALITY).decode()
    tags = read_tags(data[at + bases : end])
    known = lambda x: None if x < 0 else x
    place = lambda x: None if x < 0 else x + 1
    return (None if qname == "*" else qname, flag, known(tid), place(pos), None if mapq == 255 else mapq, cigar, known(mtid), place(mpos), tlen, seq, qual, *(tags[k][1] if k in tags else None for k in ("RG", "RX")), list(tags.items()))


def region_bin(begin: int, end: int) -> int:
    """The smallest bin of the standard scheme that holds [begin, end)."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


CODES = bytes(BASES.find(chr(c)) if chr(c) in BASES else 15 for c in range(256))


def encode(row) -> bytes:
    """The bytes of one row of READS."""
    ops = parsed(row["cigar"] or "")
    span = spanned(ops)
    name = (row["qname"] or "*").encode() + b"\0"
    seq = row["seq"] or ""
    codes = np.frombuffer(seq.upper().encode("ascii", "replace").translate(CODES) + b"\0" * (len(seq) % 2), np.uint8)
    qual = row["qual"] or ""
    less = lambda x: -1 if x is None else x - 1
    known = lambda x: -1 if x is None else x
    begin = less(row["pos"])
    body = struct.pack(
        "<iiBBHHHiiii",
        known(row["tid"]),
        begin,
        len(name),
        255 if row["mapq"] is None else row["mapq"],
        region_bin(max(begin, 0), max(begin, 0) + span) if begin >= 0 else 4680,
        len(ops),
        row["flag"],
        len(seq),
        known(row["mtid"]),
        less(row["mpos"]),
        row["tlen"] or 0,
    )
    body += name + packed_ops(ops)
    body += (codes[::2] << 4 | codes[1::2]).tobytes()
    body += (np.frombuffer(qual.encode(), np.uint8) - 33).tobytes() if qual else b"\xff" * len(seq)
    names = row.__fields__
    own = {c.upper(): ("Z", row[c]) for c in ("rg", "rx") if c in names}
    held = {k: (v["type"], v["value"]) for k, v in ((row["tags"] or {}) if "tags" in names else {}).items() if k not in own}
    body += b"".join(tag_bytes(k, *v) for k, v in (held | own).items() if v[1] is not None)
    return struct.pack("<i", len(body)) + body


HEAD = np.dtype([("size", "<i4"), ("tid", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("mtid", "<i4"), ("mpos", "<i4"), ("tlen", "<i4")])
HEX = b"0123456789abcdef"
TO_BASES = bytes.maketrans(HEX, BASES.encode())
TO_HEX = bytes(HEX[c] for c in bytes(range(256)).upper().translate(CODES))
SCHEMA = to_arrow_schema(READS)
PIECE = 8 << 20  # bytes of a batch that are encoded at once
NONE = pa.scalar(b"", pa.binary())


def binary(ends: np.ndarray, values) -> pa.Array:
    """The values cut at their ends."""
    offsets = np.concatenate([[0], ends]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def cut(data: bytes, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data[begin:end] of each."""
    return binary(np.cumsum(ends - begins), b"".join(map(data.__getitem__, map(slice, begins.tolist(), ends.tolist()))))


def joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*parts, NONE)


def each(column: pa.Array, f, kind: pa.DataType) -> pa.Array:
    """f of each value, made once for equal ones; null stays null."""
    coded = column.dictionary_encode()
    return pa.array([f(x) for x in coded.dictionary.to_pylist()], kind).take(coded.indices)


def parsed(cigar: str) -> list[tuple[int, str]]:
    """(length, operation) of a cigar."""
    ops, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            ops.append((int(n), c))
            n = ""
    return ops


def spanned(ops) -> int:
    """Places of the reference that (length, operation) take, one at least."""
    return sum(k for k, c in ops if c in "MDN=X") or 1


def packed_ops(ops) -> bytes:
    return struct.pack(f"<{len(ops)}I", *[k << 4 | OPS.index(c) for k, c in ops])


def unpacked_ops(data: bytes) -> list[tuple[int, str]]:
    return [(x >> 4, OPS[x & 15]) for x in struct.unpack(f"<{len(data) // 4}I", data)]


def bins(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """region_bin() of each."""
    out = np.zeros(len(begin), np.int64)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = np.where(begin >> shift == (end - 1) >> shift, first + (begin >> shift), out)
    return out


def tag_areas(batch: pa.RecordBatch) -> pa.Array:
    """The tags of each row as bytes: those of the map that have no column of their own, then those that have one."""
    names = batch.schema.names
    own = [c for c in ("rg", "rx") if c in names]
    parts = []
    if "tags" in names and (held := batch.column("tags")).null_count < len(held):
        hidden = {c.upper() for c in own}
        offsets = held.offsets
        low, size = offsets[0].as_py(), offsets[-1].as_py() - offsets[0].as_py()
        keys, items = held.keys.slice(low, size), held.items.slice(low, size)
        texts = [x.cast(pa.string()) for x in (keys, *items.flatten())]
        whole = pc.binary_join_element_wise(*texts, "\0")

        def entry(x):
            key, kind, value = x.split("\0", 2)
            return b"" if key in hidden else tag_bytes(key, kind, value)

        entries = pc.fill_null(each(whole, entry, pa.binary()), NONE)
        lists = pa.ListArray.from_arrays(pc.subtract(offsets, offsets[0]), entries)
        parts.append(pc.binary_join(lists, NONE))
    for c in own:
        parts.append(pc.fill_null(joined(f"{c.upper()}Z".encode(), batch.column(c).cast(pa.binary()), b"\0"), NONE))
    return joined(*parts) if parts else pa.array([b""] * batch.num_rows, pa.binary())


def encode_batch(batch: pa.RecordBatch) -> list[bytes]:
    """The bytes of the rows of a batch with the columns of READS, in order."""
    n = batch.num_rows
    if n > 1 and batch.nbytes > PIECE:
        return encode_batch(batch.slice(0, n // 2)) + encode_batch(batch.slice(n // 2))
    if not n:
        return []
    text = lambda c: pc.fill_null(batch.column(c).cast(pa.string()), "")
    whole = lambda c, missing: pc.fill_null(batch.column(c).cast(pa.int64()), missing).to_numpy()
    name, cigar, seq, qual = (text(c) for c in ("qname", "cigar", "seq", "qual"))
    flag, tid, mtid, tlen = (whole(c, x) for c, x in (("flag", -1), ("tid", -1), ("mtid", -1), ("tlen", 0)))
    pos, mpos, mapq = whole("pos", 0) - 1, whole("mpos", 0) - 1, whole("mapq", 255)
    name = pc.if_else(pc.equal(name, ""), "*", name).cast(pa.binary())
    ops = cigar.dictionary_encode()
    shapes = [parsed(x) for x in ops.dictionary.to_pylist()]
    span = np.array([spanned(x) for x in shapes], np.int64)[ops.indices]
    count = np.array([len(x) for x in shapes], np.int64)[ops.indices]
    size = pc.binary_length(name).to_numpy() + 1
    bounds = ((flag, 0, 1 << 16), (mapq, 0, 256), (size, 0, 256), (count, 0, 1 << 16), *((x, -(1 << 31), 1 << 31) for x in (tid, pos, mtid, mpos, tlen)))
    if not all((x >= low).all() and (x < high).all() for x, low, high in bounds) or not (pc.all(pc.string_is_ascii(seq)).as_py() and pc.all(pc.string_is_ascii(qual)).as_py()):
        return _row_by_row(batch)
    bases = pc.binary_length(seq).to_numpy().astype(np.int64)
    # Two bases a byte: an odd one is followed by half a byte of zero.
    even = joined(seq.cast(pa.binary()), pc.if_else(pa.array(bases % 2 == 1), pa.scalar(b"=", pa.binary()), NONE))
    codes = bytes.fromhex(_values(even).translate(TO_HEX).decode("ascii"))
    packed = binary(np.cumsum((bases + 1) // 2), codes)
    lengths = pc.binary_length(qual).to_numpy()
    shown = binary(np.cumsum(lengths), np.frombuffer(_values(qual), np.uint8) - np.uint8(33))
    filled = pc.binary_repeat(pa.scalar(b"\xff", pa.binary()), pa.array(np.where(lengths == 0, bases, 0)))
    parts = [name, pa.scalar(b"\0", pa.binary()), pa.array([packed_ops(x) for x in shapes], pa.binary()).take(ops.indices), packed, shown, filled, tag_areas(batch)]
    rest = joined(*parts)
    head = np.zeros(n, HEAD)
    begin = np.maximum(pos, 0)
    for field, x in {"size": pc.binary_length(rest).to_numpy() + FIXED - 4, "tid": tid, "pos": pos, "name": size, "mapq": mapq, "bin": np.where(pos >= 0, bins(begin, begin + span), 4680), "ops": count, "flag": flag, "bases": bases, "mtid": mtid, "mpos": mpos, "tlen": tlen}.items():
        head[field] = x
    return [_values(joined(binary(np.arange(1, n + 1) * FIXED, head.tobytes()), rest))]


def _values(column: pa.Array) -> bytes:
    """The bytes of all values of a text or binary array."""
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, "<i4")[column.offset : column.offset + len(column) + 1]
    return values[at[0] : at[-1]].to_pybytes() if values else b""


def _row_by_row(batch: pa.RecordBatch) -> list[bytes]:
    row = Row(*batch.schema.names)
    whole = lambda x: dict(x) if isinstance(x, list) else x
    return [encode(row(*map(whole, r.values()))) for r in batch.to_pylist()]


def heads(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The fixed parts of the records that start (with their size) at these places."""
    return np.frombuffer(data, np.uint8)[starts[:, None] + np.arange(FIXED)].view(HEAD)[:, 0]


def areas(head: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Where name, cigar, bases, qualities and tags of each record begin, and where it ends."""
    name = starts + FIXED
    cigar = name + head["name"]
    seq = cigar + 4 * head["ops"].astype(np.int64)
    qual = seq + (head["bases"].astype(np.int64) + 1) // 2
    tags, end = qual + head["bases"], starts + 4 + head["size"]
    if (head["name"] < 1).any() or (head["bases"] < 0).any() or (tags > end).any():
        raise ValueError("a record is longer than it says")
    return [name, cigar, seq, qual, tags, end]


def last_places(data: bytes, head: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Last place (from 1) that each placed record takes."""
    at = areas(head, starts)
    return head["pos"] + each(cut(data, at[1], at[2]), lambda x: spanned(unpacked_ops(x)), pa.int64()).to_numpy()


WIDTHS = np.zeros(256, np.int64)  # bytes of a tag's value by its kind
for _kinds, _width in ((b"AcC", 1), (b"sS", 2), (b"iIf", 4)):
    WIDTHS[list(_kinds)] = _width


def text_tags(data: bytes, begins: np.ndarray, ends: np.ndarray, names: list[str]) -> dict[str, pa.Array] | None:
    """The values of some text tags of the areas that begin and end there, null where there is none; None if arrays or other kinds need a closer look."""
    low = int(begins.min()) if len(begins) else 0
    raw = np.frombuffer(data, np.uint8)
    zeros = np.append(np.flatnonzero(raw[low : int(ends.max()) if len(ends) else 0] == 0) + low, len(raw))
    found = {n: (np.full(len(begins), -1), np.zeros(len(begins), np.int64)) for n in names}
    rows, at = np.flatnonzero(begins < ends), begins[begins < ends]
    while len(rows):  # a step for each tag of the record that has most
        if (at + 3 > ends[rows]).any():
            return None
        first, second, kind = raw[at], raw[at + 1], raw[at + 2]
        text = (kind == ord("Z")) | (kind == ord("H"))
        if not (text | (WIDTHS[kind] > 0)).all():
            return None
        stop = np.where(text, zeros[np.minimum(np.searchsorted(zeros, at + 3), len(zeros) - 1)] + 1, at + 3 + WIDTHS[kind])
        if (stop > ends[rows]).any():
            return None
        for name, (begin, end) in found.items():
            own = (first == ord(name[0])) & (second == ord(name[1])) & (begin[rows] < 0)
            if not text[own].all():
                return None
            begin[rows[own]], end[rows[own]] = at[own] + 3, stop[own] - 1
        more = stop < ends[rows]
        rows, at = rows[more], stop[more]
    return {n: _where(begin >= 0, cut(data, np.maximum(begin, 0), end).cast(pa.string())) for n, (begin, end) in found.items()}


def _where(keep: np.ndarray, values: pa.Array) -> pa.Array:
    """The values to keep, null in place of others."""
    return pc.if_else(pa.array(keep), values, pa.scalar(None, values.type))


def decode_batch(data: bytes, starts: np.ndarray, ords: np.ndarray, columns: list[str]) -> pa.RecordBatch:
    """Columns of READS, of the records that start (with their size) at these places."""
    head = heads(data, starts)
    name, cigar, seq, qual, tags, end = areas(head, starts)
    raw = np.frombuffer(data, np.uint8)
    number = lambda x, missing: pa.array(x.astype(np.int32), mask=missing)
    known = lambda x: number(x, x < 0)
    place = lambda x: number(x.astype(np.int64) + 1, x < 0)

    def names():
        texts = cut(data, name, cigar - 1).cast(pa.string())
        return _where(pc.not_equal(texts, "*").to_numpy(zero_copy_only=False), texts)

    def bases():
        n = head["bases"].astype(np.int64)
        pairs = _values(cut(data, seq, qual)).hex().encode().translate(TO_BASES)
        odd = n % 2 == 1
        if odd.any():
            pairs = np.delete(np.frombuffer(pairs, np.uint8), np.cumsum(n + n % 2)[odd] - 1)
        return binary(np.cumsum(n), pairs).cast(pa.string())

    def qualities():
        missing = raw[np.minimum(qual, len(raw) - 1)] == 255
        texts = cut(data, qual, np.where(missing, qual, tags))
        return binary(np.cumsum(np.where(missing, 0, tags - qual)), _values(texts).translate(SHOWN_QUALITY)).cast(pa.string())

    asked = [c for c in ("rg", "rx", "tags") if c in columns]
    found = text_tags(data, tags, end, [c.upper() for c in asked]) if asked and "tags" not in asked else None
    held = {c: found[c.upper()] if found else None for c in asked}
    if asked and not found:
        coded = cut(data, tags, end).dictionary_encode()
        found = [read_tags(x) for x in coded.dictionary.to_pylist()]
        for c in held:
            own = [list(x.items()) for x in found] if c == "tags" else [x[c.upper()][1] if c.upper() in x else None for x in found]
            held[c] = pa.array(own, SCHEMA.field(c).type).take(coded.indices)
    made = {
        "ord": lambda: pa.array(ords, pa.int64()),
        "qname": names,
        "flag": lambda: pa.array(head["flag"].astype(np.int32)),
        "tid": lambda: known(head["tid"]),
        "pos": lambda: place(head["pos"]),
        "mapq": lambda: number(head["mapq"], head["mapq"] == 255),
        "cigar": lambda: each(cut(data, cigar, seq), lambda x: "".join(f"{k}{c}" for k, c in unpacked_ops(x)), pa.string()),
        "mtid": lambda: known(head["mtid"]),
        "mpos": lambda: place(head["mpos"]),
        "tlen": lambda: pa.array(head["tlen"].astype(np.int32)),
        "seq": bases,
        "qual": qualities,
    }
    return pa.record_batch([held[c] if c in held else made[c]() for c in columns], schema=pa.schema([SCHEMA.field(c) for c in columns]))

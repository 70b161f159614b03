"""Records in batches equal records one by one; many short ranges share tasks."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from readloom.schema import READS
from readloom.sources import bam, records
from tests.test_bam_ranges import long_rows, write


def odd_rows(n):
    rng = random.Random(7)
    pick = rng.choice
    out = []
    for k in range(n):
        seq = pick([None, "".join(rng.choices("ACGTNacgtn=RYx*", k=pick([0, 1, 2, 7, 40, 301])))])
        qual = pick([None, "", "".join(chr(rng.randint(33, 126)) for _ in seq or "")])
        tags = pick([None, {}, {"NM": ("i", "5"), "XZ": ("Z", "a b"), "XA": ("A", "q"), "XF": ("f", "1.5"), "RG": ("Z", "hidden"), "NN": ("i", None)}, {"XB": ("B", "s,1,-2"), "XZ": ("Z", "")}])
        held = tags and {name: {"type": kind, "value": value} for name, (kind, value) in tags.items()}
        out.append((k, pick([None, "", "*", f"q{k}", "é"]), rng.randint(0, 65535), pick([None, 0, 4]), pick([None, 0, 1, rng.randint(1, 1 << 28)]), pick([None, 0, 255]), pick([None, "", "40M", "5S3M2I1D4N6H"]), pick([None, 1]), pick([None, 0, 77]), pick([None, -5]), seq, qual, pick([None, "", "rg1"]), pick([None, "AC"]), held))
    return out


def batch_of(rows, names=READS.names):
    whole = pa.record_batch([pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], f.type) for c, f in zip(zip(*rows), records.SCHEMA)], schema=records.SCHEMA)
    return whole.select(names)


def starts_of(data):
    out, at = [], 0
    while at < len(data):
        out.append(at)
        at += 4 + struct.unpack_from("<i", data, at)[0]
    return np.array(out)


@pytest.mark.parametrize("without", [(), ("tags",), ("rg", "rx"), ("rg", "rx", "tags")])
def test_a_batch_is_encoded_like_its_rows(without, monkeypatch):
    names = [n for n in READS.names if n not in without]
    rows, row = odd_rows(600), Row(*names)
    want = [records.encode(row(*(dict(zip(READS.names, r))[n] for n in names))) for r in rows]
    monkeypatch.setattr(records, "_row_by_row", None)  # the kernels alone
    batch = batch_of(rows, names)
    assert b"".join(records.encode_batch(batch)) == b"".join(want)
    assert b"".join(records.encode_batch(batch.slice(100, 33))) == b"".join(want[100:133])
    monkeypatch.setattr(records, "PIECE", 5000)
    assert b"".join(records.encode_batch(batch)) == b"".join(want)


def test_what_the_kernels_do_not_cover_goes_by_row():
    first = list(odd_rows(1)[0])
    for column, value in (("flag", 70_000), ("mapq", 300), ("qname", "x" * 300), ("flag", None)):
        bad = [*first]
        bad[READS.names.index(column)] = value
        with pytest.raises(struct.error):
            records.encode_batch(batch_of([bad]))
    first[READS.names.index("seq")], first[READS.names.index("qual")] = "ACé", ""
    assert b"".join(records.encode_batch(batch_of([first]))) == records.encode(Row(*READS.names)(*first))


@pytest.mark.parametrize("columns", [READS.names, ["rg"], ["seq", "rx"], ["ord", "tags"]])
def test_a_batch_is_decoded_like_its_records(columns):
    data = b"".join(records.encode_batch(batch_of(odd_rows(600))))
    starts = starts_of(data)
    want = batch_of([(k, *records.decode(data[a + 4 : b])) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)]))], columns).to_pylist()
    for some in (slice(None), slice(1, 500, 3), slice(0, 0)):
        assert records.decode_batch(data, starts[some], np.arange(600)[some], columns).to_pylist() == want[some]


def test_tags_are_found_without_a_loop_over_records():
    rows = [r for r in odd_rows(600) if "XB" not in (r[-1] or {})]
    data = b"".join(records.encode_batch(batch_of(rows)))
    starts = starts_of(data)
    at = records.areas(records.heads(data, starts), starts)
    found = records.text_tags(data, at[4], at[5], ["RG", "RX", "XZ"])
    assert {n: c.to_pylist() for n, c in found.items()} == {n: [records.read_tags(data[a:b]).get(n, (0, None))[1] for a, b in zip(at[4], at[5])] for n in found}


def test_many_short_ranges_share_tasks(tmp_path):
    path = tmp_path / "x.bam"
    rows = long_rows([30_000] * 120)
    write(path, rows, [("a", 1000), ("b", 900), ("c", 10**9)])
    split = 1000
    reader = bam.BamReader({"path": str(path), "split": str(split), "columns": "seq,qname"})
    tasks, ranges = reader.partitions(), -(-path.stat().st_size // split)
    assert ranges > 1200 and len(tasks) <= 520
    assert [r.begin for t in tasks for r in t.ranges] == list(range(0, path.stat().st_size, split))
    got = [r for t in tasks for batch in reader.read(t) for r in batch.to_pylist()]
    assert [(r["qname"], r["seq"]) for r in got] == [(r[1], r[10]) for r in rows] and list(got[0]) == ["qname", "seq"]

"""Token files, WARC bundles, chat formatting: exact round trips."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import chat, common, simple8b, tokens, warc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, len(v)) == v).all()


def test_simple8b_is_small_and_seekable():
    v = np.arange(5000, dtype=np.uint64) % 7
    words, offsets = simple8b.encode(v)
    assert len(words) < 5000 / 19
    part = words[offsets[2] : offsets[3]]
    assert (simple8b.decode(part, np.zeros(1, np.uint32), 1024) == v[2048:3072]).all()


ODD = ["", "a  b", "x\n y", " lead", "trail ", "a\t b", "it's  'll", "<|endoftext|> x", "日本 語 　x", "a\n\n  b", "a \nb", "a\xa0 b", "naïve ½x ²③ don't", "\x00 \x7f\x1f a", "  "]


def test_encoder_equals_the_library():
    encoder = tokens.Encoder(tokens.default_tokenizer())
    want = [e.ids for e in encoder.tokenizer.encode_batch(ODD, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(ODD)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t'abS1é.日²_-")), max_size=40))
def test_encoder_property(text):
    encoder = tokens._encoder(tokens.default_tokenizer())
    assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("joined", "at_once"), [(1, 1), (3, 2), (1024, 16)])
def test_encoder_cuts_joined_pieces_apart(monkeypatch, joined, at_once):
    monkeypatch.setattr(tokens, "JOINED", joined)
    monkeypatch.setattr(tokens, "AT_ONCE", at_once)
    encoder = tokens.Encoder(tokens.default_tokenizer())
    texts = [f"some words w{k} and x{k % 3} end \u0120 \n \n.{k}" for k in range(50)] + ODD
    got = [x.tolist() for k in range(0, len(texts), 7) for x in encoder.encode(texts[k : k + 7])]
    assert got == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_output(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(-5, None, None), (-4, "", None), (10**6, "w " * 200_000, None)], docs.schema)).withColumnRenamed("source", "start")
    got = {r.doc_id: tuple(r)[1:] for r in tokens.token_output(docs, tokens.default_tokenizer()).collect()}
    encoder, start = tokens.Encoder(tokens.default_tokenizer()), 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*encoder.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokens.token_output(docs.limit(0), tokens.default_tokenizer()).count() == 0


def test_token_output_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokens.token_output(docs, tokens.default_tokenizer()).collect())
    assert got == [(0, None, 2), (2, 1, 2), (4, 1, 2)]


def test_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = [(9001, None, None), (9002, "u", ""), (9003, "u", "dup é"), (9004, "u\r\nv: x", "dup é"), (None, "u", "dup é"), (9005, "u", "x" * 300_000)]
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema)).unionByName(pages.limit(20).selectExpr("page_id + 5000 as page_id", "url", "html"))
    rows, last = pages.collect(), {}
    for r in rows:
        p = (r.html or "").encode()
        last[p] = max(last.get(p, -1), -1 if r.page_id is None else r.page_id)
    for least in (0, 100):
        got = {r.page_id: tuple(r)[1:] for r in warc.archive_report(pages, revisit_bytes=least).collect()}
        assert len(got) == len(rows)
        for r in rows:
            p = (r.html or "").encode()
            again = len(p) >= least and last[p] != r.page_id
            assert got[r.page_id] == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", last[p] if again else None)
    assert warc.archive_report(pages.limit(0)).count() == 0


def test_records_are_fetched_through_the_index(spark):
    rows = [(k, f"http://x/{k} a\r\nb", f"page {k % 50} " * 4000) for k in range(200)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    bundles = common.stash(warc.write_bundles(pages), "warc")
    index = warc.record_index(bundles)
    assert index.count() == 201 and index.select("bundle").distinct().count() == bundles.count()
    ids = spark.createDataFrame([(3,), (170,), (199,), (None,), (1000,)], "page_id long")
    got = {r.page_id: (r.headers["WARC-Type"], bytes(r.payload), r.headers.get("WARC-Target-URI")) for r in warc.fetch(bundles, index, ids).collect()}
    assert set(got) == {3, 170, 199, None}
    assert got[3] == ("revisit", b"", "http://x/3%20a%0D%0Ab") and got[170][:2] == ("response", b"page 20 " * 4000) and got[None] == ("response", b"", None)


def test_bundle_seeks():
    writer = warc.BundleWriter()
    payloads = {f"k{i}": bytes([i]) * (50_000 + i) for i in range(40)}
    for k, p in payloads.items():
        writer.add(k, warc.record(1, "u", p, len(p), "D", None, False))
    reader = warc.BundleReader(writer.close())
    assert len(reader.places) > 3
    assert all(reader.get(k)[1] == p for k, p in reversed(payloads.items()))
    with pytest.raises(KeyError):
        reader.get("none")
    with pytest.raises(ValueError):
        warc.BundleReader(b"not a bundle at all")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab<|\\\nn>_imstarend", max_size=20), st.text(alphabet="ab<|\\\n>_imstarend", max_size=40)), max_size=6))
def test_turns_round_trip(turns):
    assert list(chat.read_turns("".join(chat.write_turn(r, t)[0] for r, t in turns))) == turns


def test_chat_query(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(chat, "PART", 300)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    odd = [(9001, 0, None, None), (9001, 1, "assistant", "a\\ <| <\\| \\\\<|im_end|>\n<"), (9001, 1, "assistant", "b"), (9002, 5, "we\nird<|", "|x\r\n"), (None, 1, "assistant", "é")]
    rows = rows.unionByName(spark.createDataFrame(odd, rows.schema))
    said = "<|im_end|><|im_start|>assistant ok"
    talks = {-1: [(0, "user", said), (1, "assistant", said)]}
    for r in rows.collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in chat.chat_query(rows).collect()}
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(chat.write_turn(r, t)[0] for _, r, t in turns)
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
        assert tuple(got[conv])[1:] == want
    assert [r.conv_id for r in chat.chat_query(rows.limit(0)).collect()] == [-1]


def test_reply_trees(spark):
    rows = [
        (1, 1, None, 0.0),
        (1, 2, 1, 1.0),
        (1, 3, 1, 2.0),
        (1, 4, 3, -5.0),
        (1, 5, 2, 0.5),
        (2, 1, 9, None),
        (3, 1, 2, 0.0),
        (3, 2, 1, 0.0),
        (3, 3, 1, 0.0),
        (None, 1, None, 0.0),
        (None, 2, 1, 0.0),
    ] + [(4, k, k - 1 if k else None, 1.0) for k in range(20)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {}
    for r in chat.paths(m, score="score", branches=2).collect():
        got.setdefault((r.tree, r.leaf), {})[r.depth] = r.node
    flat = {k: [v[d] for d in range(len(v))] for k, v in got.items()}
    assert flat == {(1, 4): [1, 3, 4], (1, 5): [1, 2, 5], (2, 1): [1], (None, 2): [1, 2], (4, 19): list(range(20))}
    best = {(r.tree, r.leaf) for r in chat.paths(m, score="score").collect()}
    assert best == {(1, 5), (2, 1), (None, 2), (4, 19)}


def test_a_conversation_minus_one_of_the_table_stays_apart(spark):
    rows = [(-1, 0, "user", "mine"), (-1, 1, "assistant", None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id is None, r.n_turns, r.loss_chars) for r in chat.chat_query(df).collect())
    assert got == [(False, 2, 0), (False, 2, 34), (True, 1, 0)]

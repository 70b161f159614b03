"""Token-ID output: encode documents, write Simple-8b chunks, read them back.

Documents are range-partitioned by ascending id; each task encodes its documents
and packs their ids (with the end id after each) into chunks of whole documents.
The files are Parquet tables of chunks that Spark commits per task, so a lost
executor costs its tasks only. A chunk row holds its shard (the task's place in id
order), its number, and a payload: magic, counts, document ids with a null flag,
document lengths, block offsets, words.

Ids come from the tokenizers library. A byte-level tokenizer splits a text before
each single space that stands between other characters, so the texts of a batch are
cut into space-led pieces and each distinct piece of the batch is coded once: the
distinct pieces go to the library as texts of a few thousand pieces, and come apart
again at the tokens that begin with a space. The pieces that a worker met first stay
with it in Arrow, up to KEEP of them and KEEP_BYTES, so its memory is bounded. A text for which that could differ
(repeated spaces, a space at an end, a special token), and any text under a
tokenizer of another kind, is encoded whole.

Defined results: a null text is empty and gives the end id alone; null ids come
first; equal ids keep together in the order of a hash of their texts; an empty table gives no chunks.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import simple8b
from readloom.llm.common import pieces, stash

MAGIC = b"S8BTOK01"
CHUNK = 1 << 17
BATCH = 8 << 20  # bytes of text that are cut into pieces at once
KEEP, KEEP_BYTES = 400_000, 16 << 20  # pieces, and their bytes, that a worker keeps
JOINED, AT_ONCE = 1024, 16  # pieces in a text for the library, and such texts in a call
_workers: dict = {}


class Encoder:
    """Encodes arrays of texts to id arrays; keeps a bounded number of pieces from call to call."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_pieces = not kind.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        del kind
        vocabulary = self.tokenizer.get_vocab()
        self.led = np.zeros(max(vocabulary.values()) + 1, bool)  # the ids of tokens that begin with a space
        self.led[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

        self.known = pa.array([], pa.string())
        self.known_ids, self.known_lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts cannot be cut at spaces."""
        if not self.by_pieces:
            return np.ones(len(texts), bool)
        odd = [pc.match_substring(texts, "  "), pc.starts_with(texts, " "), pc.ends_with(texts, " "), *(pc.match_substring(texts, s) for s in self.special)]
        return np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in odd])

    def _distinct(self, led: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of space-led pieces, one after the other."""
        ids, lengths = [], []
        for at in range(0, len(led), JOINED * AT_ONCE):
            part = led.slice(at, JOINED * AT_ONCE)
            bounds = np.append(np.arange(0, len(part), JOINED), len(part)).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(bounds, part), " ").to_pylist()
            flat = np.concatenate(self._library([" " + x for x in joined]))
            first = np.flatnonzero(self.led[flat])
            if len(first) != len(part) or (len(first) and first[0]):
                each = self._library([" " + x for x in part.to_pylist()])
                flat, first = np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1]
            ids.append(flat)
            lengths.append(np.diff(np.append(first, len(flat))))
        return (np.concatenate(ids), np.concatenate(lengths)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text; no text may be null."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = self._whole(texts)
        out: list = [None] * len(texts)
        for k, ids in zip(np.flatnonzero(whole).tolist(), self._library(texts.filter(pa.array(whole)).to_pylist())):
            out[k] = ids
        own = np.flatnonzero(~whole)
        if not len(own):
            return out
        split = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        edge = split.offsets.to_numpy().astype(np.int64)
        flat = split.values
        head = np.zeros(len(flat), bool)  # the first piece of a text has no space before it
        head[edge[:-1]] = True
        heads = self._library(flat.filter(pa.array(head)).to_pylist())
        coded = flat.filter(pa.array(~head)).dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.known)
        missing = known.is_null().to_numpy(zero_copy_only=False)
        new = coded.dictionary.filter(pa.array(missing))
        new_ids, new_lengths = self._distinct(new)
        ids, length = np.concatenate([self.known_ids, new_ids]), np.concatenate([self.known_lengths, new_lengths])
        place = np.cumsum(length) - length
        index = np.where(missing, len(self.known) + np.cumsum(missing) - 1, known.fill_null(0).to_numpy())[coded.indices.to_numpy()]
        n, begin = length[index], place[index]
        end = np.cumsum(n)
        rest = ids[np.arange(end[-1] if len(end) else 0) + np.repeat(begin - end + n, n)]
        cut = np.concatenate([[0], end])[edge - np.arange(len(edge))]
        more = KEEP - len(self.known)
        if more > 0 and len(new) and self.known.nbytes < KEEP_BYTES:
            self.known = pa.concat_arrays([self.known, new.slice(0, more)])
            self.known_lengths = length[: len(self.known)]
            self.known_ids = ids[: self.known_lengths.sum()]
        for k, h, a, b in zip(own.tolist(), heads, cut[:-1].tolist(), cut[1:].tolist()):
            out[k] = np.concatenate([h, rest[a:b]])
        return out


def _encoder(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def pack(ids: list, docs: list[np.ndarray]) -> bytes:
    """The payload of one chunk."""
    values = np.concatenate(docs)
    words, offsets = simple8b.encode(values)
    null = np.array([i is None for i in ids], np.uint8)
    return b"".join(
        [
            MAGIC,
            struct.pack("<QQQQ", len(ids), len(values), len(offsets), len(words)),
            np.array([i or 0 for i in ids], "<i8").tobytes(),
            null.tobytes(),
            np.array([len(d) for d in docs], "<u8").tobytes(),
            offsets.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )


def unpack(payload: bytes) -> tuple[list, list[np.ndarray]]:
    """(document ids, id arrays) of one chunk."""
    if payload[:8] != MAGIC:
        raise ValueError("not a token chunk")
    docs, n, blocks, words = struct.unpack_from("<QQQQ", payload, 8)
    at, parts = 40, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", blocks), ("<u8", words)):
        parts.append(np.frombuffer(payload, kind, count, at))
        at += parts[-1].nbytes
    ids, null, lengths, offsets, packed = parts
    values = simple8b.decode(packed, offsets, n).astype("<u4")
    return [None if z else int(i) for i, z in zip(ids, null)], np.split(values, np.cumsum(lengths)[:-1].astype(np.int64))


def encode_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """Chunks (shard, chunk, start, n_docs, n_ids, payload) in ascending id order; start counts within the shard."""

    def run(batches):
        encoder, shard, chunk = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, coded, size, start = [], [], 0, 0

        def flush():
            return pa.record_batch({"shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "start": pa.array([start], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64()), "n_ids": pa.array([size], pa.int64()), "payload": pa.array([pack(ids, coded)], pa.binary())})

        for batch in batches:
            for part in pieces(batch, "text", BATCH):
                for i, values in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text"))):
                    ids.append(i)
                    coded.append(np.append(values, np.uint32(end_id)))
                    size += len(coded[-1])
                    if size >= CHUNK:
                        yield flush()
                        ids, coded, size, start, chunk = [], [], 0, start + size, chunk + 1
        if ids:
            yield flush()
        pa.default_memory_pool().release_unused()  # workers live on

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The hash deals out rows of one id, or without an id, like any others.
    by = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return ordered.mapInArrow(run, "shard int, chunk long, start long, n_docs long, n_ids long, payload binary")


def read_documents(chunks: DataFrame, digest) -> DataFrame:
    """(doc_id, start, n_tokens, and what digest(ids) gives) per document of written chunks.

    start counts the ids of all documents before: a chunk knows its place in its
    shard, and the sums of the shards, one row per writing task, are broadcast.
    """
    from pyspark.sql import Window

    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    base = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    placed = chunks.join(F.broadcast(base), "shard").select((F.col("base") + F.col("start")).alias("start"), "payload")

    def run(batches):
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload").to_pylist()):
                ids, values = unpack(payload)
                n = np.array([len(v) for v in values], np.int64)
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(ids, pa.int64()),
                        "start": pa.array(start + np.cumsum(n) - n, pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()),
                        "ids_crc32": pa.array([digest(v) for v in values], pa.int64()),
                    }
                )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_output(docs: DataFrame, tokenizer: str, **columns) -> DataFrame:
    """Write the chunks to the shared folder and return what is read back from them."""
    return read_documents(stash(encode_documents(docs, tokenizer, **columns), "tokens"), crc32)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

"""Language identification with a bidirectional gated recurrent network over bytes.

The network labels every byte position of a text; a document's probabilities are the
mean over its positions. Texts are cut into segments of SEGMENT bytes, each run from
a zero state in both directions, so that all bytes of a text of any length are
labelled in even batches. Training is backpropagation through time in numpy.

Training sample (the only bound): about `per_label` rows of each label, chosen by a
hash of the id, with their whole texts; training draws its pieces from anywhere in
them. The labels and their counts cover all rows; prediction covers every byte.

Defined results: `und` with score 0 for a null text, a text without a letter, or if
there is nothing to learn from; rows with a null id are not learned from; repeated
rows give equal results; other columns are left out of predictions and kept by the
filter, under any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import fresh, pieces, utf8

HIDDEN = 8
SEGMENT = 128
LANES = 2048
PAD = 256


class Network:
    """Two GRUs over bytes and a softmax at every position."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        h = hidden
        self.p = {"V": np.zeros((2 * h, len(labels)), np.float32), "c": np.zeros(len(labels), np.float32)}
        for d in "fb":
            # E: gate inputs (update, reset, candidate) of each byte; the last row is padding.
            self.p[f"E{d}"] = rng.normal(0, 0.3, (PAD + 1, 3 * h)).astype(np.float32)
            self.p[f"U{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.p["V"] = rng.normal(0, 0.3, (2 * h, len(labels))).astype(np.float32)
        self._hold()

    def _hold(self):
        for d in "fb":  # padding keeps the state
            self.p[f"E{d}"][PAD] = 0
            self.p[f"E{d}"][PAD, : self.hidden] = 60

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States after each of the rows of x (time, lane); with keep, also what training needs."""
        h, table, u = self.hidden, self.p[f"E{d}"], self.p[f"U{d}"]
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        kept = []
        # Half of the gate inputs: sigmoid(a) = (1 + tanh(a / 2)) / 2 needs one kind of call.
        scale = np.concatenate([np.full(2 * h, 0.5, np.float32), np.ones(h, np.float32)])
        table, u = table * scale, u * scale
        for t in range(len(x)):
            given, own = table.take(x[t], axis=0), state @ u
            gate = np.tanh(given[:, : 2 * h] + own[:, : 2 * h])
            gate *= 0.5
            gate += 0.5
            z, r = gate[:, :h], gate[:, h:]
            new = np.tanh(given[:, 2 * h :] + r * own[:, 2 * h :])
            if keep:
                kept.append((state, z, r, new, own[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out, kept

    def states(self, x: np.ndarray, keep: bool = False):
        f, kf = self._run(x, "f", keep)
        b, kb = self._run(x[::-1], "b", keep)
        return np.concatenate([f, b[::-1]], axis=2), kf, kb

    @staticmethod
    def softmax(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Per lane, the sum over its byte positions of the label probabilities."""
        hidden = self.states(x)[0]
        out = np.zeros((x.shape[1], len(self.labels)))
        for t in range(0, len(x), 16):
            p = self.softmax(hidden[t : t + 16] @ self.p["V"] + self.p["c"])
            out += np.einsum("tlc,tl->lc", p, (x[t : t + 16] != PAD).astype(np.float32))
        return out

    def step(self, x: np.ndarray, y: np.ndarray):
        """Gradients of the mean cross-entropy over positions."""
        h = self.hidden
        states, kf, kb = self.states(x, keep=True)
        live = (x != PAD).astype(np.float32)
        p = self.softmax(states @ self.p["V"] + self.p["c"])
        loss = -(np.log(p[:, np.arange(len(y)), y] + 1e-9) * live).sum() / live.sum()
        p[:, np.arange(len(y)), y] -= 1
        d = p * (live / live.sum())[:, :, None]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["V"] = np.einsum("tlh,tlc->hc", states, d)
        g["c"] = d.sum((0, 1))
        back = d @ self.p["V"].T
        for name, kept, inputs, up in (("f", kf, x, back[:, :, :h]), ("b", kb, x[::-1], back[::-1, :, h:])):
            u, carry = self.p[f"U{name}"], np.zeros((x.shape[1], h), np.float32)
            for t in range(len(x) - 1, -1, -1):
                before, z, r, new, own = kept[t]
                dh = carry + up[t]
                dz = dh * (before - new) * z * (1 - z)
                dn = dh * (1 - z) * (1 - new * new)
                dr = dn * own * r * (1 - r)
                inner = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"U{name}"] += before.T @ inner
                carry = dh * z + inner @ u.T
                np.add.at(g[f"E{name}"], inputs[t], np.concatenate([dz, dr, dn], axis=1))
        return loss, g

    def train(self, texts: list[bytes], y: list[int], *, steps: int = 400, lanes: int = 128, time: int = 48, rate: float = 0.02, seed: int = 7):
        """Adam on random pieces, labels drawn evenly."""
        rng = np.random.default_rng(seed)
        y = np.array(y)
        of = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for n in range(1, steps + 1):
            label = rng.integers(0, len(of), lanes)
            x = np.full((time, lanes), PAD, np.int64)
            for lane, k in enumerate(label):
                text = texts[rng.choice(of[k])]
                at = rng.integers(0, max(1, len(text) - time + 1))
                part = np.frombuffer(text[at : at + time], np.uint8)
                x[: len(part), lane] = part
            _, g = self.step(x, label)
            size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            now = rate * min(1, 2 * (1 - n / (steps + 1)))
            for k, v in g.items():
                v *= min(1, 1 / (size + 1e-9))
                m[k] += 0.1 * (v - m[k])
                s[k] += 0.01 * (v * v - s[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
            self._hold()
        return self

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities of each non-empty text."""
        n = np.array([-(-len(t) // SEGMENT) for t in texts])
        owner = np.repeat(np.arange(len(texts)), n)
        joined = np.full(int(n.sum()) * SEGMENT, PAD, np.int16)
        at = 0
        for t, k in zip(texts, n.tolist()):
            joined[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += k * SEGMENT
        rows = joined.reshape(-1, SEGMENT)
        out = np.zeros((len(texts), len(self.labels)))
        for at in range(0, len(rows), LANES):
            np.add.at(out, owner[at : at + LANES], self.pooled(np.ascontiguousarray(rows[at : at + LANES].T)))
        return out / np.maximum(1, [[len(t)] for t in texts])


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_label: int):
    """The training sample, bounded in rows: labels, and the whole text that each belongs to."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out("id"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(per_label / n))])[F.col("lang")]
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).where(F.col("text").rlike(r"\p{L}"))
    got = drawn.select("id", "lang", "text").orderBy("id", "lang", "text").limit(2 * per_label * len(counts)).collect()
    return [r.lang for r in got], [r.text.encode() for r in got]


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 400, **training) -> Network | None:
    lang, texts = sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_label=per_label)
    labels = sorted(set(lang))
    if not labels:
        return None
    return Network(labels).train(texts, [labels.index(x) for x in lang], **training)


def predict(docs: DataFrame, network: Network | None, *, text_col: str = "text", lang_to: str = "lang_pred", score_to: str = "score") -> DataFrame:
    """docs with the columns lang_to and score_to added (columns of those names are replaced)."""
    names = [c for c in docs.columns if c not in (lang_to, score_to)]
    letter = fresh(names, "letter")
    rows = docs.select(*[f"`{c}`" for c in names]).withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    if network is None:
        return rows.drop(letter).withColumns({lang_to: F.lit("und"), score_to: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        net = shared.value
        for batch in batches:
            for part in pieces(batch, text_col, 2 << 20):
                texts = [t if k else None for t, k in zip(utf8(part.column(text_col)), part.column(letter).to_pylist())]
                own = [k for k, t in enumerate(texts) if t]
                lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if own:
                    p = net.documents([texts[k] for k in own])
                    lang[own] = np.array(net.labels, object)[p.argmax(1)]
                    score[own] = np.clip(p.max(1), 0, 1)
                keep = [c for c in part.schema.names if c != letter]
                yield pa.record_batch([*(part.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score)], names=[*keep, lang_to, score_to])

    schema = docs.select(*[f"`{c}`" for c in names]).schema.add(lang_to, "string").add(score_to, "double")
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from the rows that are not held out."""
    network = learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = predict(rows, network)
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, *, min_score: float = 0.35, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs whose language the network knows with at least min_score; all columns kept."""
    network = learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    done = predict(docs, network, text_col=text_col, lang_to=lang, score_to=score)
    return done.where((F.col(lang) != "und") & (F.col(score) >= min_score)).select(*[f"`{c}`" for c in docs.columns])

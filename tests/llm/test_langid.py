"""Language ID: gradients, held-out accuracy, edge rows; and the whole pipeline."""

import numpy as np
import pytest

from readloom.llm import langid, queries


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(97, 105, (6, 4))
    x[4:, 1] = langid.PAD
    y = np.array([0, 1, 2, 1])
    _, g = net.step(x, y)
    for name, i in [("V", (1, 2)), ("c", (0,)), ("Ef", (99, 4)), ("Eb", (100, 7)), ("Uf", (2, 5)), ("Ub", (0, 8)), ("Ub", (1, 1))]:
        losses = []
        for sign in (1, -1):
            net.p[name][i] += sign * 1e-3
            losses.append(net.step(x, y)[0])
            net.p[name][i] -= sign * 1e-3
        assert abs((losses[0] - losses[1]) / 2e-3 - g[name][i]) < 2e-3


def test_padding_changes_nothing():
    net = langid.Network(["a", "b"], hidden=4)
    texts = [b"abc", b"hello world", b"x" * 500]
    whole = net.documents(texts)
    for t, p in zip(texts, whole):
        assert np.allclose(net.documents([t])[0], p, atol=1e-6)


def scalar_scores(net, text):
    """Mean label probabilities by one loop per byte and unit."""
    import math

    h, total = net.hidden, [0.0] * len(net.labels)
    sigmoid = lambda a: 1 / (1 + math.exp(-a))

    def walk(part, d):
        state, out = [0.0] * h, []
        e, u = net.p[f"E{d}"], net.p[f"U{d}"]
        for b in part:
            own = [sum(state[i] * float(u[i, k]) for i in range(h)) for k in range(3 * h)]
            z = [sigmoid(float(e[b, k]) + own[k]) for k in range(h)]
            r = [sigmoid(float(e[b, h + k]) + own[h + k]) for k in range(h)]
            new = [math.tanh(float(e[b, 2 * h + k]) + r[k] * own[2 * h + k]) for k in range(h)]
            state = [z[k] * state[k] + (1 - z[k]) * new[k] for k in range(h)]
            out.append(state)
        return out

    for at in range(0, len(text), langid.SEGMENT):
        part = text[at : at + langid.SEGMENT]
        for f, b in zip(walk(part, "f"), walk(part[::-1], "b")[::-1]):
            both = f + b
            logits = [sum(both[i] * float(net.p["V"][i, k]) for i in range(2 * h)) + float(net.p["c"][k]) for k in range(len(net.labels))]
            e = [math.exp(x - max(logits)) for x in logits]
            total = [t + x / sum(e) for t, x in zip(total, e)]
    return [t / len(text) for t in total]


def test_scores_equal_a_scalar_network(spark):
    rows = [(k, f"{word} " * (5 + k), lang) for k in range(40) for word, lang in (("the cat is here", "en"), ("le chat est là", "fr"))]
    docs = spark.createDataFrame([(2 * k + i, *r[1:]) for k, r in enumerate(rows) for i in (0, 1)], "doc_id long, text string, lang string")
    net = langid.learn(docs, steps=20)
    texts = {1: "the cat", 2: "là " * 90, 3: "x", 4: "é" * 64 + "a", 5: "123 b"}
    new = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in langid.predict(new, net).collect():
        want = scalar_scores(net, texts[r.doc_id].encode())
        assert abs(r.score - max(want)) < 1e-4 and r.lang_pred == net.labels[want.index(max(want))]


def test_training_sample_holds_whole_texts(spark):
    text = "a" * 3000 + "b" * 300000 + "é" * 3000
    docs = spark.createDataFrame([(k, text, "en") for k in range(20)], "doc_id long, text string, lang string")
    lang, texts = langid.sample(docs, id_col="doc_id", text_col="text", lang_col="lang", per_label=100)
    assert len(lang) == len(texts) > 5 and set(texts) == {text.encode()}


def test_accepted_keeps_columns_of_any_name(spark):
    rows = [(1, "the cat", "en", "s", "l", "p"), (2, "le chat", "fr", "s", "l", "p"), (3, "7", "en", "s", "l", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, letter string, lang_pred string")
    docs = docs.withColumn("_score", docs.score)
    out = langid.accepted(docs, steps=3, min_score=0.0)
    assert out.schema == docs.schema and sorted(map(tuple, out.collect())) == sorted(r for r in map(tuple, docs.collect()) if r[0] != 3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_language_id(spark, sf)
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(lang, "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, "the cat", "en"), (2, None, "en"), (3, "12 34!", "en"), (4, "", None), (None, "el gato", "es"), (5, "a" * 20_000, None), (9, "le chat noir", "fr"), (9, "le chat noir", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.selectExpr("*", "1 as score", "2 as lang_pred")
    out = {r.doc_id: r for r in langid.identify(docs, steps=5).collect()}
    assert {k: out[k].lang_pred for k in (2, 3, 4)} == dict.fromkeys((2, 3, 4), "und")
    assert out[1].lang_pred in ("en", "fr") and out[2].score == 0.0
    assert langid.identify(docs.limit(0)).count() == 0
    nothing = langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    kept = langid.accepted(docs, steps=5, min_score=0.0)
    assert kept.columns == docs.columns and kept.count() == 5


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "a clean text with a null id", "en", None, 1), (10**7, None, None, "src0", None), (10**7 + 1, "12 34", "en", "src0", 0)], docs.schema)
    now, names = docs.unionByName(odd), docs.columns
    from readloom.llm.common import stash

    counts = [now.count()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        now = stash(stage(spark, now, sf_dir), "test")
        counts.append(now.count())
        if k + 1 < len(pipeline.STAGES):
            assert now.columns == names
    assert counts[1] == counts[0] - 2 and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] >= counts[3] and counts[5] == counts[4]
    assert "n_tokens" in now.columns

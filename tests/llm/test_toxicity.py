"""Toxicity: the index against brute force, calibration, held-out accuracy, edge rows, and that scores depend on texts alone."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import toxicity
from readloom.llm.common import table


def made(n=700, terms=60, seed=1):
    rng = random.Random(seed)
    examples = [{rng.randrange(terms): rng.randint(1, 4) for _ in range(rng.choice([0, 1, 3, 8]))} for _ in range(n)]
    idf = np.array([rng.uniform(0.5, 6) for _ in range(terms)])
    label = np.array([float(rng.random() < 0.3) for _ in range(n)])
    return toxicity.Index([f"t{k}" for k in range(terms)], idf, examples, list(range(n)), label, np.ones(n)), examples, rng


def cosine(index, a, b):
    va, vb = ({t: (1 + math.log(c)) * index.idf[t] for t, c in x.items()} for x in (a, b))
    return sum(va[t] * vb[t] for t in va.keys() & vb.keys()) / (math.sqrt(sum(x * x for x in va.values())) * math.sqrt(sum(x * x for x in vb.values())) or 1)


def test_nearest_is_exact_and_prunes():
    index, examples, rng = made()
    read = held = 0
    for _ in range(300):
        query = {rng.randrange(60): rng.randint(1, 3) for _ in range(rng.choice([0, 1, 2, 6]))}
        number, got, blocks = index.nearest(query, 10)
        want = sorted(((cosine(index, query, e), -int(index.place[k])) for k, e in enumerate(examples) if query and e), reverse=True)
        want = [x for x in want if x[0] > 0][:10]
        assert np.allclose(got, [c for c, _ in want])
        assert (np.diff(got) <= 0).all() and len(set(number.tolist())) == len(number)
        for k, c in zip(number.tolist(), got.tolist()):
            assert abs(cosine(index, query, examples[index.ids[k]]) - c) < 1e-9
        read, held = read + blocks, held + index.blocks
    assert read < 0.8 * held


def test_one_example_is_left_out_and_ties_go_to_the_smaller_number():
    index = toxicity.Index(["a", "b"], np.ones(2), [{0: 1}] * 90 + [{1: 1}], list(range(91)), np.zeros(91), np.ones(91))
    assert index.nearest({0: 2}, 5)[0].tolist() == [0, 1, 2, 3, 4]
    assert index.nearest({0: 2}, 5, without=2)[0].tolist() == [0, 1, 3, 4, 5]
    assert index.nearest({}, 5)[0].tolist() == [] and toxicity.Index([], np.zeros(0), [], [], np.zeros(0), np.zeros(0)).nearest({}, 5)[2] == 0


def test_calibration_is_isotonic():
    index, _, rng = made()
    votes = toxicity.Votes(index, 10, 1.0)
    x = np.array([rng.random() for _ in range(2000)])
    y = (np.array([rng.random() for _ in range(2000)]) < x**2).astype(float)
    votes.calibrate(x, y, np.ones(2000))
    assert (np.diff(votes.levels) > 0).all()
    for at in (0.1, 0.5, 0.9):
        assert abs(float(np.interp(at, votes.knots, votes.levels)) - at * at) < 0.12


def documents(n=900):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice("the of and a to in is it on by".split()) for _ in range(rng.randint(3, 60))]
        bad = k % 6 == 0
        for _ in range(rng.randint(1, 3) * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile", "rotten", "NASTY", "foul"]))
        rows.append((k, " ".join(words), "x", 0.5))
        if k % 3 == 0:
            labels.append((k, 0, int(bad)))
    return rows, labels


def test_scores_on_held_out_and_edge_rows(spark):
    rows, labels = documents()
    edge = [(10_001, None, "x", 1.0), (10_002, "", "x", 1.0), (10_003, " ,;", "x", 1.0), (None, "so foul", "x", 1.0), (10_004, "of the vile" * 3 + " vile" * 5000, "x", 1.0), (10_004, "of the", "x", 1.0)]
    docs = spark.createDataFrame([*rows, *edge], "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1), (3, 1, 0), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, known)
    got = out.collect()
    assert len(got) == len(rows) + len(edge)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 10_000:
            assert r.predicted == int(r.doc_id % 6 == 0)
    by = {(r.doc_id, r.predicted): r for r in got}
    assert (10_001, 0) in by and (10_002, 0) in by and (10_003, 0) in by and (None, 1) in by and (10_004, 1) in by and (10_004, 0) in by
    assert by[None, 1].near_labels == [1, 1, 1] and not by[10_002, 0].near_ids
    # Nothing but the text counts: other ids, languages and sources of new rows give the same scores.
    votes = toxicity.learn(docs.selectExpr("doc_id as id", "text"), known.selectExpr("doc_id as id", "cast(toxic as double) as label"))
    again = toxicity.score(docs.selectExpr("doc_id + 5 as id", "text"), votes).collect()
    assert sorted(r.score for r in again) == sorted(r.score for r in got)


def test_no_example_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert all(r.score in (0.0, 1.0) for r in toxicity.toxicity(docs, one).collect())
    assert toxicity.toxicity(docs.limit(0), one).count() == 0


def test_sample_is_thinned_by_text_and_weighted(spark):
    rows = [(k, f"text {k // 2}") for k in range(800)]
    docs = spark.createDataFrame(rows, "id long, text string")
    labels = docs.selectExpr("id", "cast(id % 10 < 2 as double) as label")
    got = toxicity.examples(docs, labels, 40).collect()
    assert len({r.text for r in got}) == len(got)
    assert all(zlib.crc32(str(r.id).encode()) % 4 != 2 for r in got)
    weights = {r.label: r.weight for r in got}
    assert weights[0.0] > 2 * weights[1.0] >= 2 and 15 <= sum(r.label == 1 for r in got) <= 70


@pytest.mark.parametrize("name", ["op13_toxicity"])
def test_query_on_tables(spark, sf_dir, name):
    from readloom.llm import queries

    out = queries.QUERIES[name](spark, sf_dir)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    docs = table(spark, sf_dir, "documents")
    rows = out.collect()
    assert len(rows) == docs.count()
    clear = {r.doc_id for r in docs.where(F.col("text").rlike("(?i)idiot|moron|scum|stupid")).collect()}
    hit = [r.predicted for r in rows if r.doc_id in clear]
    assert sum(hit) >= 0.8 * len(hit)

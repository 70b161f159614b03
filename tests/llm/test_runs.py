"""Runs of words: the catchers against brute force, batches against single words, edge rows."""

import random

import numpy as np
import pytest

from readloom.llm import runs


def brute(words, min_length, min_exponent):
    n, out = len(words), {}
    for p in range(1, n // min_exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(min_length, min_exponent * p):
                out.setdefault((start, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


@pytest.mark.parametrize("min_length,min_exponent", [(24, 3), (2, 2), (6, 2), (4, 3)])
def test_catchers_find_all_runs(min_length, min_exponent):
    rng = random.Random(min_length * 10 + min_exponent)
    for trial in range(150):
        words = []
        while len(words) < rng.randint(0, 200):
            part = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 30))]
            words += part * rng.choice([1, 2, 3, 5])
        want = brute(words, min_length, min_exponent)
        for batch in (1, 13, 4096) if trial % 10 == 0 else (64, 4096):
            assert runs.find_runs(np.array(words, np.int64), min_length, min_exponent, batch) == want


def test_runs_are_known_as_soon_as_they_are_there():
    catchers, words = runs.Catchers(24, 3), [7, *[1, 2, 3, 4] * 9, 8, 9]
    for n, w in enumerate(words, 1):
        catchers.append(np.array([w]))
        assert catchers.runs() == brute(words[:n], 24, 3)


def test_long_texts_of_one_word_and_of_long_periods():
    assert runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert runs.find_runs(np.arange(90_000) % 30_000) == [(0, 90_000, 30_000)]
    assert runs.find_runs(np.arange(90_000) % 30_001) == []


def test_collapse_edges(spark):
    long = " ".join(f"w{i % 5}" for i in range(30))
    rows = [(1, long, "x"), (1, long, "x"), (2, None, "x"), (3, "", "x"), (4, " \n\t", "x"), (None, "a " * 24, "x"), (5, "a " * 23, "x"), (6, "b c b c", "x"), (7, f"p q {long} r", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.text) for r in runs.collapse(docs).collect()), key=repr)
    first = "w0 w1 w2 w3 w4"
    want = [(1, 1, 0, 30, 5, 6000, first)] * 2 + [(k, 0, None, None, None, None, "") for k in (2, 3, 4)] + [(None, 1, 0, 24, 1, 24000, "a")]
    want += [(5, 0, None, None, None, None, ("a " * 23).strip()), (6, 0, None, None, None, None, "b c b c"), (7, 1, 2, 30, 5, 6000, f"p q {first} r")]
    assert got == sorted(want, key=repr)
    assert runs.collapse(docs.limit(0)).count() == 0 and runs.report(docs).count() == len(rows)


def test_longest_compares_exactly():
    assert runs.longest([(5, 30, 10), (2, 33, 11), (0, 24, 8)]) == (0, 24, 8)
    assert runs.longest([(9, 10**9 + 1, 10**9), (1, 10**9, 10**9 - 1)]) == (1, 10**9, 10**9 - 1)
    assert runs.longest([]) is None

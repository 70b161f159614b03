"""Near-copies by five-word similarity against exact components."""

import math
import random

import numpy as np

from readloom.llm import similar


def test_one_of_each_is_exact_on_families(spark):
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    docs, n = {}, 0
    for _ in range(25):
        base = [word() for _ in range(200)]
        for edits in (0, 0, 1, 3, 12, 40):
            text = list(base)
            for k in random.sample(range(200), edits):
                text[k] = word()
            docs[n] = " ".join(text)
            n += 1
    sets = {i: similar.shingles(t.encode(), 5) for i, t in docs.items()}
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in docs:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    rows = [(i, t, "x") for i, t in docs.items()] + [(None, docs[0], "x"), (1000, None, "x"), (1001, "", "x"), (5000, docs[7].upper(), "x"), (5000, docs[7], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hub string")
    out = similar.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == sorted([*{root(i) for i in docs}, -1, 1000, 1001])
    assert similar.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_finds_a_base_that_is_never_the_hub(spark):
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(400)]
    rows = []
    for n in range(201):
        text = list(base)
        for k in random.sample(range(400), 8) if n != 100 else []:
            text[k] = word()
        rows.append((n, " ".join(text)))
    sets = [similar.shingles(t.encode(), 5) for _, t in rows]
    rate = lambda a, b: len(a & b) / len(a | b)
    assert min(rate(s, sets[100]) for s in sets) >= 0.8
    assert sum(rate(sets[0], s) >= 0.8 for s in sets) <= 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in similar.one_of_each(df).collect()] == [0]


LEAST = similar.PLACES * 5 // 8


def family(n, seed, chance, words=300):
    """Texts that share about `chance` of their words' places with one base."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(words)]
    return [" ".join(w if rng.random() < chance else word() for w in base) for _ in range(n)]


def cell_of(texts, labels, key_band=None, chunks=None):
    """A cell of texts whose hub is in none of them."""
    orders = similar._orders()
    signed = [similar.lowest(t.encode(), 5, 42, orders) for t in texts]
    n = len(texts)
    low = np.stack([(x[1] & np.uint32(255)).astype(np.uint8) for x in signed])
    bands = np.stack([x[0][::2] for x in signed]).view(np.int64)
    numbers = np.zeros((8, n), np.int64)
    numbers[0] = 1 if key_band is None else 0
    numbers[1] = 0 if key_band is None else bands[0, key_band]
    numbers[4], numbers[5], numbers[7] = np.arange(n), labels, -1
    if chunks is not None:
        numbers[3], numbers[6] = 1, chunks
    return similar.Cell(numbers, low, bands)


def exact(texts, similarity=0.8):
    sets = [similar.shingles(t.encode(), 5) for t in texts]
    return {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}


def test_cells_decide_each_pair_once_and_whatever_the_chunks():
    texts = family(40, 2, 0.97)
    labels = np.array([k if k % 4 else 0 for k in range(40)])
    whole = cell_of(texts, labels)
    whole.bands = np.arange(40 * similar.BANDS).reshape(40, similar.BANDS)  # no band in common
    pairs = [(int(max(a, b)), int(min(a, b))) for i, j, _ in whole.left(LEAST) for a, b in zip(i, j)]
    assert len(pairs) == len(set(pairs))
    agree = (whole.low[:, None] == whole.low[None, :]).sum(2)
    assert set(pairs) == {(i, j) for i in range(40) for j in range(i) if labels[i] != labels[j] and agree[i, j] >= LEAST}
    halves = []
    for k, (one, two) in enumerate([(0, 0), (1, 1), (0, 1)]):
        of = [x for x in range(40) if x % 2 in (one, two)]
        part = cell_of([texts[x] for x in of], labels[of], chunks=np.array(of) % 2)
        part.ids, part.bands, part.one_chunk = np.array(of), whole.bands[of], one == two
        halves += [(int(max(part.ids[a], part.ids[b])), int(min(part.ids[a], part.ids[b]))) for i, j, _ in part.left(LEAST) for a, b in zip(i, j)]
    assert sorted(halves) == sorted(pairs)
    # Members that share the first band decide there, and nowhere else.
    whole.bands[:, 0] = 7
    assert not [1 for i, _, _ in whole.left(LEAST) if len(i)]
    whole.kind, whole.key = 0, 7
    assert sum(len(i) for i, _, _ in whole.left(LEAST)) == len(pairs)
    whole.bands[:, 3] = whole.key = 9
    assert not [1 for i, _, _ in whole.left(LEAST) if len(i)]


def test_links_join_what_is_similar_and_save_pairs():
    texts = [t for seed in range(6) for t in family(12, seed, 0.99)]
    n = len(texts)
    cell = cell_of(texts, np.arange(n))
    cell.bands = np.arange(n * similar.BANDS).reshape(n, similar.BANDS)
    sets = [np.unique(np.fromiter((similar.xxhash.xxh64_intdigest(x, 42) for x in similar.shingles(t.encode(), 5)), np.uint64)) for t in texts]
    found, decided = cell.links(sets, similar.fewest(0.8), 0.8)
    want = exact(texts)
    assert set(found) <= want and slow_components(n, found) == slow_components(n, want)
    assert decided < len(want) / 2  # what is joined already is not decided again


def slow_components(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_a_family_below_the_bound_costs_no_rows(spark, monkeypatch):
    """Near-copies that all just miss the bound: each text goes to its cells once, no pair is a row, and all stay."""
    texts = family(120, 5, 0.974, words=400)
    assert len(exact(texts)) < 40
    tables, kept = [], similar.stash
    monkeypatch.setattr(similar, "stash", lambda df, label: tables.append((label, kept(df, label))) or tables[-1][1])
    monkeypatch.setattr(similar, "unstash", lambda df: None)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = similar.similar_groups(df).collect()
    found = {r.node: r.component for r in groups}
    want = slow_components(len(texts), exact(texts))
    assert [found.get(k, k) for k in range(len(texts))] == want
    size = lambda label: sum(t.count() for name, t in tables if name == label)
    assert 0 < size("open") <= similar.BANDS * len(texts) and size("rated") <= similar.BANDS * len(texts)


def test_small_chunks_give_the_same_groups(spark, monkeypatch):
    texts = [t for seed in range(3) for t in family(25, seed, 0.985)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = slow_components(len(texts), exact(texts))
    whole = similar.cells
    for options in ({}, {"most": 4}, {"most_bytes": 6000}):
        monkeypatch.setattr(similar, "cells", lambda *a, o=options: whole(*a, **o))
        found = {r.node: r.component for r in similar.similar_groups(df).collect()}
        assert [found.get(k, k) for k in range(len(texts))] == want


def test_every_link_is_decided_on_the_shingle_sets(spark):
    assert sum(math.comb(similar.PLACES, k) * 0.8**k * 0.2 ** (similar.PLACES - k) for k in range(similar.fewest(0.8))) < 1e-9
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    a = [word() for _ in range(400)]
    b = a + [word() for _ in range(2)]  # practically equal, yet below a bound of 0.999
    df = spark.createDataFrame([(0, " ".join(a)), (1, " ".join(b)), (2, " ".join(a).upper())], "doc_id long, text string")
    (_, x, _), (_, y, _) = (similar.lowest(" ".join(t).encode(), 5, 42, similar._orders()) for t in (a, b))
    assert (x == y).mean() >= 0.96
    assert sorted(r.doc_id for r in similar.one_of_each(df, similarity=0.999).collect()) == [0, 1]

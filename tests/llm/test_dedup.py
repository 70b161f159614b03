"""SimHash, repeated substrings and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from readloom.llm import decontaminate, graph, simhash, substrings
from readloom.llm import words as words_


def slow_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(rows, radius=2):
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, f) in enumerate(rows):
        for j, g in rows[:k]:
            if (f ^ g).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


def test_simhash_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(9001, None, None), (9002, " \t\n", None), (9003, "One", None), (9004, "one", None), (9005, "a b", None)], docs.schema)
    docs = docs.unionByName(extra)
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    groups = slow_components(rows)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.simhash_query(docs).collect()}
    assert got == {i: (f, groups[i]) for i, f in rows}


@pytest.mark.parametrize(("leaf", "fan_bits"), [(8192, 4), (8, 2), (3, 1)])
def test_links_connect_exactly(spark, leaf, fan_bits):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    x = [base]
    for _ in range(5):
        y = base.copy()
        for _ in range(rng.integers(1, 4)):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y), dtype=np.uint64)
        x.append(y)
    dense = np.arange(64, dtype=np.uint64) << np.uint64(7)
    x = np.unique(np.concatenate([*x, dense]))
    want = slow_components([(int(v), int(v)) for v in x])
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = {int(np.int64(r.node).view(np.uint64)): r.component for r in graph.components(simhash.links(df, leaf=leaf, fan_bits=fan_bits)).collect()}
    same = {}
    for v in x.tolist():
        same.setdefault(found.get(v, ("alone", v)), set()).add(want[v])
    assert all(len(s) == 1 for s in same.values()) and len(same) == len(set(want.values()))


def test_gray_index_finds_every_link_and_prunes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.unique(np.concatenate([rng.integers(0, 1 << 63, 1500, dtype=np.uint64), rng.integers(0, 1 << 12, 300, dtype=np.uint64)]))
    tables = []
    kept = simhash.stash
    monkeypatch.setattr(simhash, "stash", lambda df, label: tables.append((label, kept(df, label))) or tables[-1][1])
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").repartition(3)
    got = {tuple(sorted((int(np.int64(r.u).view(np.uint64)), int(np.int64(r.v).view(np.uint64))))) for r in simhash.links(df, leaf=4, fan_bits=3).collect()}
    far = np.bitwise_count(x[:, None] ^ x[None, :])
    all_links = {(int(x[i]), int(x[j])) for i, j in zip(*np.nonzero(far <= 2)) if i < j}
    assert got <= all_links
    whole = lambda pairs: slow_partition(x.tolist(), pairs)
    assert whole(got) == whole(all_links) and len(all_links) > 500
    leaves = next(t.count() for label, t in tables if label == "level")
    assert [t.count() for label, t in tables if label == "pairs"][-1] < leaves**2 / 8


@pytest.mark.parametrize("twig", [2, 4, 64])
def test_leaves_are_searched_by_their_own_levels(twig):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base ^ np.uint64(1) << np.uint64(k) for k in rng.integers(0, 60, 30).tolist()]))
    gray = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(k)
    x = x[np.argsort(gray)]
    for a, b in ((x, x), (x[:700], x[700:]), (x[:130], x[130:]), (x[:1], x[1:])):
        i, j = simhash.near_pairs(a, b, 2, a is b, twig=twig)
        near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 2
        want = np.nonzero(np.triu(near, 1) if a is b else near)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(z.tolist() for z in want)))
    # What ancestors have compared is not counted twice, and what they found counts.
    assert len(simhash.near_pairs(x, x, 2, True, seen=(1 << 64) - 1, far=0, twig=twig)[0]) == len(simhash.near_pairs(x, x, 2, True, twig=twig)[0])
    assert not len(simhash.near_pairs(x, x, 2, True, seen=0, far=3, twig=twig)[0])


def test_the_index_prunes_at_shipped_parameters(spark):
    """On sf0.1 differences added up on the way down leave out pairs of nodes at the lower levels; the pairs that are left connect what all links connect."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    fps = np.unique([r.fp for r in simhash.fingerprints(docs).select("fp").distinct().collect()]).view(np.uint64)
    assert simhash.leaf_size(len(fps)) == 1024 and simhash.leaf_size(900) == 64 and simhash.leaf_size(10**9) == simhash.LEAF == 16384
    gray = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(k)
    x, watch = fps[np.argsort(gray)], []
    i, j = simhash.near_pairs(x, x, 2, True, watch=watch)
    assert [size for size, _, _ in watch] == [1024, 64]
    # Pairs of lowest nodes: fewer are compared in full than one level of bounds would leave.
    low, mask = simhash._agreed(x, 64)
    one_level = np.triu(np.bitwise_count((low[:, None] ^ low) & mask[:, None] & mask) <= 2).sum()
    assert watch[-1][2] <= one_level < len(low) * (len(low) + 1) / 2 / 2
    tables, kept = [], simhash.stash
    simhash.stash = lambda df, label: tables.append((label, kept(df, label))) or tables[-1][1]
    try:
        got = [(int(np.int64(r.u).view(np.uint64)), int(np.int64(r.v).view(np.uint64))) for r in simhash.links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")).collect()]
    finally:
        simhash.stash = kept
    levels = [t.count() for label, t in tables if label == "level"]
    assert levels[0] == -(-len(x) // 1024) or levels[0] <= len(x) // 1024 + 12  # the last leaf of each task is shorter
    assert slow_partition(x.tolist(), got) == slow_partition(x.tolist(), [(int(x[a]), int(x[b])) for a, b in zip(i.tolist(), j.tolist())])


def slow_partition(nodes, pairs):
    up = {v: v for v in nodes}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {v: root(v) for v in nodes}


def test_spanning_forest():
    u, v = simhash.spanning(np.array([0, 1, 5, 5, 7]), np.array([1, 2, 6, 5, 6]), 9)
    assert slow_partition(range(9), zip(u.tolist(), v.tolist())) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 100), (200, 201), (201, 200)], "u long, v long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 200: 200, 201: 200}
    assert graph.components(edges.limit(0)).count() == 0


def test_one_of_each(spark):
    rows = [(1, "a b c d e", 1), (2, "a b c d e", 2), (3, "something else here now", 3), (3, "something else here now", 4), (None, "a b c d e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 3]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_keeps_different_texts_of_an_id_and_any_names(spark):
    rows = [(1, "a b c d e", 1, 1), (2, "a b c d e", 2, 2), (7, "one text of this id", 3, 3), (7, "a b c d e", 4, 4), (7, None, 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int, _dropped int")
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.gone) for r in out.collect()) == [(1, 1), (7, 3), (7, 5)]


def slow_substrings(docs, length):
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("gram", "most"), [(16, 4096), (16, 20), (40, 4096)])
def test_substrings_brute_force(spark, gram, most):
    random.seed(3)
    text = lambda n: "".join(random.choice("abcdefghij é") for _ in range(n))
    shared = [text(60) for _ in range(6)] + ["x" * 80, "ab" * 50]
    docs = [(i, "".join(random.choice([text(random.randint(1, 50)), random.choice(shared)]) for _ in range(random.randint(0, 12)))) for i in range(80)]
    hot = text(70)
    docs += [(1000 + i, text(30) + hot + text(30)) for i in range(40)] + [(2000, None), (2001, ""), (2002, docs[3][1]), (2003, docs[3][1])]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, version int")
    got = {r.doc_id: tuple(r)[1:5] for r in substrings.digest(df, length=40, gram=gram, most=most).collect()}
    assert got == slow_substrings(docs, 40)


def test_substrings_edges(spark):
    docs = spark.createDataFrame([(None, "q" * 900), (1, "q" * 400), (2, "z" * 399), (2, "z" * 399)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in substrings.digest(docs).collect())
    assert got == [(0, 900, 1), (1, 400, 1), (2, 0, 0), (2, 0, 0)]
    assert substrings.digest(docs.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("most_bytes", [32 << 20, 60_000])
def test_decontamination_brute_force(spark, sf_dir, most_bytes):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bench = bench.unionByName(spark.createDataFrame([(901, "the of"), (902, "..."), (903, None), (904, "The OF!"), (None, "of the")], bench.schema))
    docs = docs.unionByName(spark.createDataFrame([(7001, None), (7002, "THE of éa"), (7003, "")], docs.schema))
    windows = {}
    for r in bench.collect():
        own = word_list(r.text)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[i : i + n]), set()).add("null" if r.item_id is None else str(r.item_id))
    want = {}
    for r in docs.collect():
        own, hit, items = word_list(r.text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[tuple(own[i : i + n])]
        want[r.doc_id] = (len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs, bench, most_bytes=most_bytes).collect()}
    assert got == want
    clean = decontaminate.remove_documents(docs, bench, most_bytes=most_bytes)
    assert {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[4]}
    cut = decontaminate.remove_spans(docs, bench.where("item_id < 900"), most_bytes=most_bytes)
    assert cut.columns == docs.columns
    assert decontaminate.report(cut.limit(0), bench).count() == 0


def test_spans_are_cut_alike_in_any_number_of_parts(spark):
    word = lambda k: f"a{k} b{k} c{k}"
    chain = " ".join(word(k) for k in range(16))
    items = [(k, " ".join(chain.split()[3 * k : 3 * k + 10])) for k in range(13)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, f"x {chain}, y", "h"), (1, f"x {chain}, y", "i"), (2, None, "j"), (3, "clean text", "k"), (None, chain, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit string")
    few = decontaminate.remove_spans(docs, bench, most_bytes=1500)
    assert len(decontaminate._parts(bench, "item_id", "text", 10, 1500)) > 2
    for out in (few, decontaminate.remove_spans(docs, bench)):
        assert out.columns == docs.columns
        got = {r.hit: r.text for r in out.collect()}
        assert {k: got[k] for k in "hijk"} == {"h": f"x {word(15)[3:]}, y", "i": f"x {word(15)[3:]}, y", "j": None, "k": "clean text"}


def test_a_long_item_is_cut_into_runs(spark):
    own = [f"w{k}" for k in range(500)]
    bench = spark.createDataFrame([("long", " ".join(own).upper())], "item_id string, text string")
    parts = decontaminate._parts(bench, "item_id", "text", 10, 8 * decontaminate.SET_BYTES * 60)
    assert len(parts) > 1
    docs = spark.createDataFrame([(k, " ".join(own[k : k + 10])) for k in range(490)] + [(1000, " ".join(own[:9]))], "doc_id long, text string")
    got = decontaminate.report(docs, bench, most_bytes=8 * decontaminate.SET_BYTES * 60)
    assert {r.doc_id: (r.n_hit, r.n_items) for r in got.collect()} == {**dict.fromkeys(range(490), (10, 1)), 1000: (0, 0)}


def test_words_equal_a_plain_split(monkeypatch):
    random.seed(1)
    texts = [None, b"", b" ,", "A b1-é  \U0001f600x\n".encode(), *(bytes(random.choice(b"aZ 9.\n") for _ in range(random.randint(0, 400))) for _ in range(50))]
    monkeypatch.setattr(words_, "SCAN", 64)
    words = words_.Words(texts)
    want = [(k, w) for k, t in enumerate(texts) for w in (t or b"").translate(words_.WORDS).split()]
    got = [(int(k), words.data[s:e]) for k, s, e in zip(words.text, words.start, words.end)]
    assert got == want
    by = {}
    for (_, w), h in zip(want, words.hash.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_cut_spans_keeps_the_rest():
    windows = decontaminate.Windows([("1", b"b c d")], 3)
    assert decontaminate.cut_spans("A, b  C-d. e b c", windows) == "A, . e b c"
    assert decontaminate.cut_spans(None, windows) is None


def test_no_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert tuple(decontaminate.report(docs, none).first())[1:4] == (2, 0, 0)

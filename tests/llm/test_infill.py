"""Fill-in-middle against a plain version, and edge rows."""

import hashlib
import re

from pyspark.sql import functions as F

from readloom.llm import infill


def plain_version(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return key, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_equals_plain_version(spark):
    texts = ["The quick brown fox", "", None, "x", "éa 日本語\n\tz", "a<P>b", "<S>", "<<M>>", "<P <S M> >", "\U0001f600 ok\u0000end", "  ", "aB" * 5000 + " " + "-" * 3000, "1 < 2 <M c"]
    rows = [(k * 100 + j if k or j else None, t, j, "own") for j, t in enumerate(texts) for k in range(12)]
    docs = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string, n int, form string")
    out = infill.fill_in_middle(docs).withColumn("text", infill.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = sorted(((*plain_version(r[0], r[1]), r[1] or "") for r in [*rows, *rows[:3]]), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_rates(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "concat('text number ', id) as text")
    assert infill.report(docs.limit(0)).count() == 0
    forms = lambda **o: {r.form for r in infill.fill_in_middle(docs, **o).collect()}
    assert forms(rate=0) == {"plain"} and forms(rate=100, suffix_first=0) == {"psm"} and forms(rate=100, suffix_first=100) == {"spm"}


def test_batches_of_any_size_agree(spark, monkeypatch):
    docs = spark.range(50).selectExpr("id as doc_id", "repeat(concat('ab, ', id), cast(id as int)) as text")
    want = sorted(map(tuple, infill.report(docs).collect()), key=repr)
    monkeypatch.setattr(infill, "MOST", 64)
    assert sorted(map(tuple, infill.report(docs).collect()), key=repr) == want

"""Fill-in-middle: texts cut into prefix, middle and suffix of whole units, in prefix or suffix order.

A unit is a run of ASCII letters or one other character. Two cuts fall at hashes of the
id, as do the choice to leave a text plain and the order of the parts, so a rerun gives
the same rows.

Each Arrow batch goes through one pipeline of array kernels. A byte that no UTF-8 text
holds is put behind every unit and splits the texts into lists; the lists are flattened
with the number of their text; a unit's ordinal is its place less the place where its
list begins; filters by ordinal give the units of each role, lists are rebuilt from them
by the number of units each text gives to the role, and joined to one piece per text and
role. The pieces are joined with the markers by form. No kernel runs per text.

Defined results: a null text is empty; an empty text, one that holds a marker, and the
share that the hash leaves out are plain; a null id hashes as "1:"; repeated rows give
equal results each; other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import pieces

#: Fixed values of the output: what stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit as bytes of UTF-8: ASCII letters, another ASCII character, or a lead byte and what follows it.
UNIT = rb"[A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFF][\x80-\xBF]*"
END = b"\xff"
#: Bytes of text that are cut at once.
MOST = 2 << 20

SHOWN = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """(units of each text, its [prefix, middle, suffix]); the cuts are taken modulo one more than the units."""
    marked = pc.replace_substring_regex(texts.cast(pa.binary()), pattern=UNIT, replacement=rb"\0" + END)
    lists = pc.split_pattern(marked, END)  # the last part of a list is what follows the last unit: nothing
    counts = pc.subtract(pc.list_value_length(lists), 1).cast(pa.int64())
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    begin = pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])[:-1], pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(units))), begin.take(parent))
    room = pc.add(counts, 1)
    a, b = (pc.subtract(h, pc.multiply(pc.divide(h, room), room)) for h in (first, second))
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    borders = [pa.array(np.zeros(len(texts), np.int64)), low, high, counts]
    out = []
    for start, stop in zip(borders, borders[1:]):
        of_role = pc.and_(pc.greater_equal(ordinal, start.take(parent)), pc.less(ordinal, stop.take(parent)))
        edges = np.concatenate([[0], np.cumsum(pc.subtract(stop, start).to_numpy())]).astype(np.int32)
        rebuilt = pa.ListArray.from_arrays(pa.array(edges), units.filter(of_role))
        out.append(pc.binary_join(rebuilt, b""))
    return counts, out


def formatted(text: pa.Array, hashes: list[pa.Array], rate: int, suffix_first: int) -> list[pa.Array]:
    """The columns n, form, prefix_chars, middle_chars and output of a batch of texts."""
    text = pc.fill_null(text, "")
    counts, (prefix, middle, suffix) = cut(text, hashes[0], hashes[1])
    last = lambda h: pc.subtract(h, pc.multiply(pc.divide(h, 100), 100))
    plain = pc.or_(pc.equal(counts, 0), pc.greater_equal(last(hashes[2]), rate))
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(text, marker))
    form = pc.if_else(plain, "plain", pc.if_else(pc.less(last(hashes[3]), suffix_first), "spm", "psm"))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, b"")
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, b"")
    output = pc.if_else(pc.equal(form, "psm"), psm, pc.if_else(plain, text.cast(pa.binary()), spm)).cast(pa.string())
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.string())).cast(pa.int64())) for x in (prefix, middle)]
    return [counts, form, *chars, output]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: int = 90, suffix_first: int = 20, salt: str = "1:") -> DataFrame:
    """Per row of docs: doc_id, n units, form (plain, psm, spm), prefix_chars, middle_chars, output.

    Of the texts that can be cut, `rate` percent are, and of those `suffix_first` percent as spm.
    """
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *hashes)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", MOST):
                done = formatted(part.column("text").cast(pa.string()), [part.column(f"h{k}") for k in range(4)], rate, suffix_first)
                yield pa.record_batch([part.column("doc_id"), *done], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, SHOWN)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output of a form was made.

    A cut text holds no marker and no marker has a border, so each stands in the output once.
    """
    head = F.substring_index(F.substring_index(output, MIDDLE, 1), SUFFIX, 1)
    tail = F.substring_index(output, MIDDLE, -1)
    behind = F.substring_index(F.substring_index(output, MIDDLE, 1), SUFFIX, -1)
    psm = F.concat(F.substring_index(head, PREFIX, -1), tail, behind)
    spm = F.concat(F.substring_index(behind, PREFIX, -1), tail, F.substring_index(behind, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of outputs and of the texts rebuilt from them."""
    rows = fill_in_middle(docs, id_col=id_col, text_col=text_col)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 AS plain, h4 % 100 < 20 AS spm FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

"""A corpus pipeline: language ID, near-dedup, decontamination, source mixing, token output.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept;
all but the last return the columns of docs, whatever their names and however many.

Nulls, ties and repeated rows. A null text has no letter and goes in the first stage; a
null id, language or source stays. Near-dedup decides by id: a row with a null id always
stays, of rows that repeat id and text one stays, rows of one id with different texts
are documents of their own, and of a group the smallest id stays. Decontamination and
language ID look at each row by itself. Mixing deals with each row, rows with a null
source as one source; equal rows share their copies evenly. Token output writes null
ids first and rows of one id in the order of a hash of their texts. Empty tables pass
every stage.
"""

from __future__ import annotations

from readloom.llm import decontaminate, langid, mixing, similar, tokens
from readloom.llm.common import stash, table


def language_id(spark, docs, sf_dir):
    """Documents without a letter, or whose language the network cannot tell, go; null and empty texts are among them."""
    return langid.accepted(docs)


def near_dedup(spark, docs, sf_dir):
    """Of each group of near-copies (SimHash, five words, similarity 0.8) the document with the smallest id stays; rows with a null id all do."""
    return similar.one_of_each(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go; one without words stays."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark, docs, sf_dir):
    """Every document stays; small sources are repeated up to twice on average, a null source like any other."""
    return mixing.mixed(docs)


def token_output(spark, docs, sf_dir):
    """Token files in ascending id order, null ids first; returns their digest per document."""
    return tokens.token_output(docs, tokens.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: SQL can express neither the network nor the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs

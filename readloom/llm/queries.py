"""The registered queries of this subpackage: opN_<name>(spark, sf_dir) over whole tables."""

from __future__ import annotations

from readloom.llm import chat, decontaminate, infill, langid, linededup, mixing, runs, simhash, substrings, tokens, topk, toxicity, warc
from readloom.llm.common import table


def op1_line_dedup(spark, sf_dir):
    return linededup.line_dedup(table(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash.simhash_query(table(spark, sf_dir, "documents"))


def op3_token_output(spark, sf_dir):
    return tokens.token_output(table(spark, sf_dir, "documents"), tokens.default_tokenizer())


def op8_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark, sf_dir):
    return substrings.digest(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("version")


def op6_warc(spark, sf_dir):
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op10_top_k(spark, sf_dir):
    return topk.top_k_query(table(spark, sf_dir, "embeddings"))


def op4_chat_format(spark, sf_dir):
    return chat.chat_query(table(spark, sf_dir, "conversations"))


def op11_periodic_runs(spark, sf_dir):
    return runs.report(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark, sf_dir):
    return infill.report(table(spark, sf_dir, "documents"))


def op13_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_token_output, op4_chat_format, op5_simhash, op6_warc, op7_substring_dedup, op8_decontaminate, op9_source_mixing, op10_top_k, op11_periodic_runs, op12_fill_in_middle, op13_toxicity)}
SQL = {
    "op1_line_dedup": linededup.SQL,
    "op4_chat_format": chat.SQL,
    "op6_warc": warc.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op9_source_mixing": mixing.SQL,
    "op10_top_k": topk.SQL,
    "op11_periodic_runs": runs.SQL,
    "op12_fill_in_middle": infill.SQL,
}

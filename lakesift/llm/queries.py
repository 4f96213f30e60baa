"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from lakesift.llm import bpe, html_template, licenses, matroska, mixing, quotes, sharding, simhash, topk, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_matroska": matroska.op2_matroska,
    "op3_topk": topk.op3_topk,
    "op4_licenses": licenses.op4_licenses,
    "op5_mixing": mixing.op5_mixing,
    "op6_html": html_template.op6_html,
    "op7_sharding": sharding.op7_sharding,
    "op8_simhash": simhash.op8_simhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quotes": quotes.op10_quotes,
}
SQL = {
    "op3_topk": topk.OP3_SQL,
    "op4_licenses": licenses.op4_sql(),
    "op5_mixing": mixing.OP5_SQL,
    "op7_sharding": sharding.op7_sql(),
    "op10_quotes": quotes.op10_sql(),
}

"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from tsubame.llm import decontaminate, html_text, hyperminhash, line_dedup, mixing, ngram_join, quality, sharding, sort_means, spelling, suffix_dedup, topk, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op10_topk": topk.op10_topk,
    "op11_hyperminhash": hyperminhash.op11_hyperminhash,
    "op12_sort_means": sort_means.op12_sort_means,
    "op13_spelling": spelling.op13_spelling,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op8_html_text": html_text.op8_html_text,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op4_sharding": sharding.op4_sharding,
}

ORACLES: dict[str, str] = {
    "op10_topk": topk.ORACLE,
    "op11_hyperminhash": hyperminhash.ORACLE,
    "op12_sort_means": sort_means.ORACLE,
    "op13_spelling": spelling.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op5_ngram_join": ngram_join.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
}

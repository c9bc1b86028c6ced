"""Queries and DuckDB SQL of the subpackage, by name."""

from __future__ import annotations

from . import align, chat_format, collocations, decontaminate, html_text, language, licenses, line_dedup, nearest, pieces, quality, simhash, token_ids

QUERIES = {
    "op1_quality_ranking": quality.query,
    "op2_html_main_text": html_text.query,
    "op3_token_shards": token_ids.query,
    "op4_benchmark_leaks": decontaminate.query,
    "op5_line_dedup": line_dedup.query,
    "op6_language": language.query,
    "op7_licenses": licenses.query,
    "op8_simhash_components": simhash.query,
    "op9_sentencepiece": pieces.query,
    "op10_nearest_vectors": nearest.query,
    "op11_chat_format": chat_format.query,
    "op12_token_alignment": align.query,
    "op13_collocations": collocations.query,
}

ORACLES = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_licenses": licenses.ORACLE,
    "op10_nearest_vectors": nearest.ORACLE,
    "op11_chat_format": chat_format.ORACLE,
    "op13_collocations": collocations.ORACLE,
}

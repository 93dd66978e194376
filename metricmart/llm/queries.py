"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from metricmart.llm import decontaminate, katz, language, line_dedup, packing, prefix_trie, quality, simhash, spelling, substring_dedup, toxicity, warc
from metricmart.llm.byte_bpe import op7_byte_bpe

QUERIES = {
    "op9_katz": katz.op9_katz,
    "op4_suffix_array": substring_dedup.op4_suffix_array,
    "op8_toxicity": toxicity.op8_toxicity,
    "op5_warc": warc.op5_warc,
    "op2_simhash": simhash.op2_simhash,
    "op10_line_chunks": line_dedup.op10_line_chunks,
    "op10_line_passages": line_dedup.op10_line_passages,
    "op1_language": language.op1_language,
    "op3_fertility": quality.op3_fertility,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_byte_bpe": op7_byte_bpe,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_packing": packing.op12_packing,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": warc.OP5_SQL,
    "op10_line_chunks": line_dedup.OP10_SQL,
    "op10_line_passages": line_dedup.OP10_PASSAGES_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op13_spelling": spelling.OP13_SQL,
}

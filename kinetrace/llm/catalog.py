"""Queries of the training-data operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

from . import exact_dedup, line_dedup, packing, pieces, pii, quality, simhash, token_files, tool_calls, topk

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_tool_calls": tool_calls.op2_tool_calls,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_simhash": simhash.op4_simhash,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_pii": pii.op6_pii,
    "op7_topk": topk.op7_topk,
    "op8_packing": packing.op8_packing,
    "op9_token_files": token_files.op9_token_files,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op7_topk": topk.ORACLE,
}

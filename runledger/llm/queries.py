"""Queries of this subpackage by name, for the driver's registry."""

from __future__ import annotations

from . import (
    chat_format,
    chunk_dedup,
    line_rules,
    lm_scoring,
    mixing,
    multi_index,
    near_dedup,
    periodic_runs,
    piece_spans,
    rule_ensemble,
    simhash,
    target_resampling,
    token_counts,
)

QUERIES = {
    fn.__name__: fn
    for fn in (
        chunk_dedup.op1_chunk_dedup,
        token_counts.op2_token_counts,
        near_dedup.op3_near_classes,
        rule_ensemble.op4_rule_ensemble,
        piece_spans.op5_pieces,
        multi_index.op6_multi_index,
        lm_scoring.op7_lm_scores,
        chat_format.op8_chat_format,
        line_rules.op9_line_rules,
        mixing.op10_mixing,
        target_resampling.op11_importance_resampling,
        simhash.op12_simhash,
        periodic_runs.op13_periodic_runs,
    )
}

#: The other queries have no SQL: hashes, tokenizers and fitted models have no counterpart
#: in DuckDB. tests/llm compares each with a brute-force version instead.
ORACLE: dict[str, str] = {"op11_importance_resampling": target_resampling.ORACLE_SQL}

"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import best_fit, importance, jaccard, line_rules, merkle, packing, repeats, segmentations, sentence_spans, sharding, site_lines, token_store, whitening


def queries() -> dict:
    return {
        "op1_hilbert_packing": packing.op1_hilbert_packing,
        "op2_gumbel_top_k": segmentations.op2_gumbel_top_k,
        "op3_line_frequency": line_rules.op3_line_frequency,
        "op4_run_length_index": repeats.op4_run_length_index,
        "op5_sentence_spans": sentence_spans.op5_sentence_spans,
        "op6_site_spread": site_lines.op6_site_spread,
        "op7_merkle": merkle.op7_merkle,
        "op8_virtual_slots": sharding.op8_virtual_slots,
        "op9_elias_fano": token_store.op9_elias_fano,
        "op10_count_vector_tree": jaccard.op10_count_vector_tree,
        "op11_word_tries": importance.op11_word_tries,
        "op12_exact_scatter": whitening.op12_exact_scatter,
        "op13_residual_packing": best_fit.op13_residual_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_frequency": line_rules.OP3_SQL,
        "op5_sentence_spans": sentence_spans.OP5_SQL,
        "op6_site_spread": site_lines.OP6_SQL,
        "op11_word_tries": importance.OP11_SQL,
    }

"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from folioscope.llm import bag_minhash, budget_mixing, chat_windows, context_pii, cross_parsing, fertility_rules, minhash_prints, piece_codec, spectral_whitening, suffix_tree_lm, token_lengths, toxic_sentences, vertical_negatives

QUERIES = {
    "op1_budget_mixing": budget_mixing.op1_budget_mixing,
    "op2_bag_minhash": bag_minhash.op2_bag_minhash,
    "op3_minhash_prints": minhash_prints.op3_minhash_prints,
    "op4_cross_parsing": cross_parsing.op4_cross_parsing,
    "op5_suffix_tree_lm": suffix_tree_lm.op5_suffix_tree_lm,
    "op6_chat_windows": chat_windows.op6_chat_windows,
    "op7_token_lengths": token_lengths.op7_token_lengths,
    "op8_toxic_sentences": toxic_sentences.op8_toxic_sentences,
    "op9_fertility_rules": fertility_rules.op9_fertility_rules,
    "op10_piece_codec": piece_codec.op10_piece_codec,
    "op11_spectral_whitening": spectral_whitening.op11_spectral_whitening,
    "op12_vertical_negatives": vertical_negatives.op12_vertical_negatives,
    "op13_context_pii": context_pii.op13_context_pii,
}

SQL: dict[str, str] = {"op1_budget_mixing": budget_mixing.SQL, "op12_vertical_negatives": vertical_negatives.SQL}

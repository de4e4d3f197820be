"""The queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, bpe, crosstok, langid, lmscore, maintext, mixing, passages, quality, sharding, simhash, trie, warc

QUERIES = {
    "op1_dictionary_warc": warc.op1_dictionary_warc,
    "op2_vantage_simhash": simhash.op2_vantage_simhash,
    "op3_word_backoff_langid": langid.op3_word_backoff_langid,
    "op4_attention_score": lmscore.op4_attention_score,
    "op5_vantage_ann": ann.op5_vantage_ann,
    "op6_threshold_rules": quality.op6_threshold_rules,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_run_length_passages": passages.op8_run_length_passages,
    "op9_block_mixture": mixing.op9_block_mixture,
    "op10_fixed_virtual_slots": sharding.op10_fixed_virtual_slots,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_token_alignment": crosstok.op12_token_alignment,
    "op13_template_text": maintext.op13_template_text,
}

ORACLES: dict[str, str] = {
    "op1_dictionary_warc": warc.OP1_SQL,
    "op6_threshold_rules": quality.OP6_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
}

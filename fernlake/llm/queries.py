"""The subpackage's queries and, where SQL can say them, their SQL."""

from __future__ import annotations

from fernlake.llm import alignment, ann_search, byte_bpe, chat_format, decontaminate, hard_negatives, language_id, ngram_join, secret_scan, simhash, token_pack, toxicity, url_rules

QUERIES = {
    "op1_token_pack": token_pack.query,
    "op2_byte_bpe": byte_bpe.query,
    "op3_language_id": language_id.query,
    "op4_simhash": simhash.query,
    "op5_url_rules": url_rules.query,
    "op6_decontaminate": decontaminate.query,
    "op7_toxicity": toxicity.query,
    "op8_secret_scan": secret_scan.query,
    "op9_chat_format": chat_format.query,
    "op10_ann_search": ann_search.query,
    "op11_token_alignment": alignment.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_ngram_join": ngram_join.query,
}

ORACLES = {"op5_url_rules": url_rules.SQL, "op9_chat_format": chat_format.SQL, "op12_hard_negatives": hard_negatives.SQL}

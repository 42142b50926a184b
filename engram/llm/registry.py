"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from engram.llm import chatformat, htmltext, lmscore, media, mixing, neardup, packing, retention, tokenalign, tokencount, topk, toxicity, urlfilter

QUERIES = {
    "op1_html_lstm": htmltext.query,
    "op2_minhash_neardup": neardup.query,
    "op3_best_fit_packing": packing.query,
    "op4_url_rules": urlfilter.query,
    "op5_media_columns": media.query,
    "op6_gru_lm": lmscore.query,
    "op7_toxicity_crf": toxicity.query,
    "op8_cube_mixing": mixing.query,
    "op9_chat_format": chatformat.query,
    "op10_exact_topk": topk.query,
    "op11_token_alignment": tokenalign.query,
    "op12_token_counts": tokencount.query,
    "op13_cohort_retention": retention.query,
}
#: Where SQL can't express an operator, tests hold it against a brute-force version.
ORACLES = {
    "op2_minhash_neardup": neardup.ORACLE_SQL,
    "op9_chat_format": chatformat.ORACLE_SQL,
    "op10_exact_topk": topk.ORACLE_SQL,
    "op13_cohort_retention": retention.ORACLE_SQL,
}

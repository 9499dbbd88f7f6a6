"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import codes, embeddings, language, lines, mixing, pages, pieces, quality, resampling, secrets, simhash, tokencounts, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_language_id": language.op2_language_id,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_embedding_near_dedup": embeddings.op4_embedding_near_dedup,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html_extraction": pages.op7_html_extraction,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_quality_rules": lines.op10_quality_rules,
    "op11_token_counts": tokencounts.op11_token_counts,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_vector_codes": codes.op13_vector_codes,
}

ORACLE_SQL = {"op1_mix_sources": mixing.OP1_SQL, "op13_vector_codes": codes.OP13_SQL}

"""Queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

from . import byte_bpe, chat_template, flac, ngram_join, packing, quality_classifier, quality_rules, secret_scan, spelling_variants, suffix_dedup, token_alignment, token_counts, url_reputation


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_quality_classifier": quality_classifier.op2_quality_classifier,
        "op3_flac": flac.op3_flac,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_byte_bpe": byte_bpe.op5_byte_bpe,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_chat_template": chat_template.op7_chat_template,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_packing": packing.op9_packing,
        "op10_url_reputation": url_reputation.op10_url_reputation,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_secret_scan": secret_scan.op12_secret_scan,
        "op13_spelling_variants": spelling_variants.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_join": ngram_join.ORACLE_SQL,
        "op7_chat_template": chat_template.ORACLE_SQL,
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op10_url_reputation": url_reputation.ORACLE_SQL,
    }

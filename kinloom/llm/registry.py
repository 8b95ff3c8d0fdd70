"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from kinloom.llm import bpe, chat, fingerprint, html_text, jaccard_join, language, packing, quality, secret_scan, url_filter


def queries():
    return {
        "op1_language_id": language.op1,
        "op2_bpe": bpe.op2,
        "op3_quality_rules": quality.op3,
        "op4_jaccard_join": jaccard_join.op4,
        "op5_url_filters": url_filter.op5,
        "op6_packing": packing.op6,
        "op7_secret_scan": secret_scan.op7,
        "op8_html_text": html_text.op8,
        "op9_fingerprint": fingerprint.op9,
        "op10_chat": chat.op10,
    }


def oracle_sql():
    return {"op3_quality_rules": quality.SQL, "op4_jaccard_join": jaccard_join.SQL, "op5_url_filters": url_filter.SQL, "op10_chat": chat.SQL}

"""The training-data queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from ravelin.llm import bpe, fertility, gif, html_extract, mixing, secrets, simhash, substring, toxicity, urls


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.query,
        "op2_toxicity": toxicity.query,
        "op3_substring_dedup": substring.query,
        "op4_secret_scan": secrets.query,
        "op5_bpe_round_trip": bpe.query,
        "op6_url_filter": urls.query,
        "op7_tokeniser_fertility": fertility.query,
        "op8_gif_media": gif.query,
        "op9_mix_sources": mixing.query,
        "op10_html_main_text": html_extract.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_secret_scan": secrets.sql(),
        "op6_url_filter": urls.sql(),
    }

"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from inkwarden.llm import bpe, content_store, html_text, line_dedup, manifest, media, mixing, pitman_yor, quality_rules, sharding, simhash, url_filters, whitening

QUERIES = {
    "op7_pitman_yor": pitman_yor.op7_pitman_yor,
    "op3_html_text": html_text.op3_html_text,
    "op1_media": media.op1_media,
    "op6_content_store": content_store.op6_content_store,
    "op5_bpe": bpe.op5_bpe,
    "op4_simhash": simhash.op4_simhash,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_whitening": whitening.op11_whitening,
    "op12_manifest": manifest.op12_manifest,
    "op13_sharding": sharding.op13_sharding,
}

ORACLES = {
    "op9_line_dedup": line_dedup.SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op10_url_filters": url_filters.SQL,
}

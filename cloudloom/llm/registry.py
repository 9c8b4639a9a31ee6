"""Queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from cloudloom.llm import bpe, chat, exact_dedup, html, language, lm, media, neardup, packing, pii

QUERIES = {
    "op1_bagminhash_neardup": neardup.query,
    "op2_pii": pii.query,
    "op3_byte_bpe": bpe.query,
    "op4_image_copies": media.query,
    "op5_cross_entropy_difference": lm.query,
    "op6_packing": packing.query,
    "op7_language_id": language.query,
    "op8_html_text": html.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_quote_linked_chat": chat.query,
}
SQL = {"op1_bagminhash_neardup": neardup.SQL, "op8_html_text": html.SQL, "op9_exact_dedup": exact_dedup.SQL, "op10_quote_linked_chat": chat.SQL}

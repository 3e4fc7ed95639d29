"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, conversation_repair, embedding_dedup, html_extraction, lm_scoring, mixing, packing, quality_classifier, quality_rules, sentencepiece_codec, sharding, simhash, vector_codes

MODULES = (
    packing, chat, quality_rules, sentencepiece_codec, html_extraction, sharding, embedding_dedup, lm_scoring, quality_classifier, simhash, mixing, conversation_repair, vector_codes,
)
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}

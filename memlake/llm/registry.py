"""The training-data queries by name, and SQL for those that it can express."""

from __future__ import annotations

import corpus_pipeline

from . import ann, audit, chat, fingerprints, html, licenses, mixing, neighbours, packing, quality, tokens, toxicity, trie

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_document_fingerprints": fingerprints.op2_document_fingerprints,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_packing": packing.op7_packing,
    "op8_html_extraction": html.op8_html_extraction,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_ngram_jaccard_join": neighbours.op10_ngram_jaccard_join,
    "op11_token_counts": tokens.op11_token_counts,
    "op12_conversation_trie": trie.op12_conversation_trie,
    "op13_filter_interactions": audit.op13_filter_interactions,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_chat_formatting": chat.ORACLE_SQL,
    "op6_license_scan": licenses.ORACLE_SQL,
    "op12_conversation_trie": trie.ORACLE_SQL,
    "op13_filter_interactions": audit.ORACLE_SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

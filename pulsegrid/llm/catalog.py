"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from pulsegrid.llm import (
    chroma_audio,
    edit_embedding,
    language_id,
    line_dedup,
    merkle_manifest,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    pii,
    suffix_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_pii": pii.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_edit_embedding": edit_embedding.query,
    "op4_packing": packing.query,
    "op5_chroma_audio": chroma_audio.query,
    "op6_language_id": language_id.query,
    "op7_toxicity": toxicity.query,
    "op8_source_mixing": mixing.query,
    "op9_line_dedup": line_dedup.query,
    "op10_ngram_join": ngram_join.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_merkle_manifest": merkle_manifest.query,
    "op13_token_counts": token_counts.query,
}
SQL = {
    "op8_source_mixing": mixing.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op12_merkle_manifest": merkle_manifest.SQL,
}

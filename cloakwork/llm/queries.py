"""The corpus operators' queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import kdsearch, langid, mixing, pieces, secretscan, simhash, substrings, suffixtree, tokenfile, vectordedup

QUERIES = {
    "op1_kdtree_top_k": kdsearch.query,
    "op2_source_mixing": mixing.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_secret_scan": secretscan.query,
    "op5_token_files": tokenfile.query,
    "op6_suffix_array_dedup": substrings.query,
    "op7_suffix_tree_scores": suffixtree.query,
    "op8_language_id": langid.query,
    "op9_embedding_near_dedup": vectordedup.query,
    "op10_sentencepiece": pieces.query,
}

ORACLES: dict[str, str] = {
    "op1_kdtree_top_k": kdsearch.ORACLE,
    "op4_secret_scan": secretscan.oracle(),
}

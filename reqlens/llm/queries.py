"""The queries of this package by name, and the DuckDB SQL of those that SQL can express."""
from __future__ import annotations

from reqlens.llm import (
    compression,
    convtrie,
    exactdup,
    kneser_ney,
    merkle,
    neardup,
    packing,
    pieces,
    secrets,
    sharding,
    tokenbin,
    topk,
    warc,
)

QUERIES = {
    "op1_kneser_ney_quality": kneser_ney.op1_kneser_ney_quality,
    "op2_fixed_width_ids": tokenbin.op2_fixed_width_ids,
    "op3_markov_secrets": secrets.op3_markov_secrets,
    "op4_compression_bands": compression.op4_compression_bands,
    "op5_chosen_path_groups": neardup.op5_chosen_path_groups,
    "op6_warc_round_trip": warc.op6_warc_round_trip,
    "op7_bm25_packing": packing.op7_bm25_packing,
    "op8_offset_pieces": pieces.op8_offset_pieces,
    "op9_stratified_interleave": sharding.op9_stratified_interleave,
    "op10_nra_top_k": topk.op10_nra_top_k,
    "op11_postorder_manifest": merkle.op11_postorder_manifest,
    "op12_chunk_recipes": exactdup.op12_chunk_recipes,
    "op13_prefix_trie": convtrie.op13_prefix_trie,
}
ORACLE = {
    "op6_warc_round_trip": warc.ORACLE,
    "op10_nra_top_k": topk.ORACLE,
    "op11_postorder_manifest": merkle.ORACLE,
    "op12_chunk_recipes": exactdup.ORACLE,
    "op13_prefix_trie": convtrie.ORACLE,
}

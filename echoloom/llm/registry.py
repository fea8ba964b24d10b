"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import collision_search, conversations, html_text, mixing, oracles, packing, quality, sharding, simhash, token_counts, token_output, topk, toxicity, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_sharding": sharding.op2_sharding,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality": quality.op4_quality,
    "op5_token_output": token_output.op5_token_output,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_topk": topk.op7_topk,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_packing": packing.op9_packing,
    "op10_html_text": html_text.op10_html_text,
    "op11_collision_search": collision_search.op11_collision_search,
    "op12_whitening": whitening.op12_whitening,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLE_SQL = {"op2_sharding": oracles.OP2, "op4_quality": oracles.OP4, "op7_topk": oracles.OP7, "op13_conversation_repair": oracles.OP13}

"""Queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, jaccard_join, lm_scoring, packing, pii, secrets, sharding, topk, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_secrets": secrets.op4_secrets,
    "op5_topk": topk.op5_topk,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_chat": chat.op7_chat,
    "op8_pii": pii.op8_pii,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_sharding": sharding.op10_sharding,
}
ORACLES = {"op5_topk": topk.OP5_SQL, "op7_chat": chat.OP7_SQL}

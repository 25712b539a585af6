"""The training-data operators' queries and SQL."""

from __future__ import annotations

from . import decontaminate, langid, near_dedup, packing, secrets, shards, suffixes, tokencount, topk, toxicity


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_top_k": topk.op4_top_k,
        "op5_pack": packing.op5_pack,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_token_count": tokencount.op7_token_count,
        "op8_language": langid.op8_language,
        "op9_shard": shards.op9_shard,
        "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE, "op2_near_dedup": near_dedup.ORACLE, "op4_top_k": topk.ORACLE}

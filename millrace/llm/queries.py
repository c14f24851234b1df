"""Registry: one query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from millrace.llm import decontam, exact_dedup, langid, mixing, neardup, ngram, pii, tokenbin, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_language_id": langid.op2_language_id,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_benchmark_decontamination": decontam.op4_benchmark_decontamination,
    "op5_token_ids": tokenbin.op5_token_ids,
    "op6_minhash_near_dedup": neardup.op6_minhash_near_dedup,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op7_source_mixing_copies": mixing.op7_source_mixing_copies,
    "op8_pii": pii.op8_pii,
    "op9_warc": warc.op9_warc,
    "op10_lm_score": ngram.op10_lm_score,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_benchmark_decontamination": decontam.SQL,
    "op7_source_mixing": mixing.SQL,
    "op7_source_mixing_copies": mixing.COPIES_SQL,
    "op9_warc": warc.SQL,
}

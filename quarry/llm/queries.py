"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import alignment, bpe, decontaminate, embedding_dedup, html_text, minhash, ngram_lm, oracles, pii, sharding, spelling, substring_dedup, token_ids, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_pii": pii.op2_pii,
    "op3_bpe": bpe.op3_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_token_ids": token_ids.op7_token_ids,
    "op8_html_text": html_text.op8_html_text,
    "op9_ngram_lm": ngram_lm.op9_ngram_lm,
    "op10_minhash": minhash.op10_minhash,
    "op11_sharding": sharding.op11_sharding,
    "op12_spelling": spelling.op12_spelling,
    "op13_alignment": alignment.op13_alignment,
}
ORACLE: dict[str, str] = oracles.ORACLE

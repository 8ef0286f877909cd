"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from textveil.llm import ann, embdedup, jaccard, langid, mixing, pii, quality, sentencepiece, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality": quality.query,
        "op2_ngram_jaccard": jaccard.query,
        "op3_warc_derivatives": warc.query,
        "op4_pii": pii.query,
        "op5_sentencepiece": sentencepiece.query,
        "op6_toxicity": toxicity.query,
        "op7_ann": ann.query,
        "op8_embedding_dedup": embdedup.query,
        "op9_language_id": langid.query,
        "op10_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_derivatives": warc.ORACLE,
        "op8_embedding_dedup": embdedup.ORACLE,
        "op10_mixing": mixing.ORACLE,
    }

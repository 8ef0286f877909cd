"""Model adapters: cut texts into windows, ask a model about each, put its answers back and keep the best of equal spans.

A model is a picklable function of a batch; it gets Arrow batches of windows, so a runtime can score many at once. Windows of a long text are
spread over tasks; only spans come together again by the text's key.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.operators.chunking import MAX_LENGTH, MAX_TOKENS, OVERLAP, TOKEN_OVERLAP, char_chunks, place, token_chunks
from textveil.operators.entities import best_per_span
from textveil.operators.names import ENTITY
from textveil.operators.tokenize import decode_spans, encode_pair

# What is asked of an extraction model, by category.
PROMPTS = {"PERSON": "人名", "ORG": "组织机构"}
SPANS = "array<struct<start:int,end:int,text:string,score:double>>"
PREDICTED = "array<struct<label:string,start:int,end:int,score:double>>"


def gathered(rows: DataFrame, keys: list[str], df: DataFrame) -> DataFrame:
    """df with `entities`: the best of equal spans of each key, by place; empty where there are none."""
    best = best_per_span(rows, keys)
    one = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "category", "text", "confidence", "model"))).alias("__e"))
    out = df.join(one, keys, "left")
    ordered = F.transform("__e", lambda e: F.struct(e["category"].alias("category"), e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"), e["confidence"].alias("confidence"), e["model"].alias("model")))
    return out.withColumn("entities", F.coalesce(ordered, F.array().cast(ENTITY))).drop("__e")


def asked(prompt: str, vocab: dict[str, int], predict: Callable, max_length: int):
    """Arrow function (window text, its start) -> spans."""

    @F.pandas_udf(SPANS)
    def ask(texts: pd.Series, starts: pd.Series) -> pd.Series:
        encodings = [encode_pair(prompt, t, vocab, max_length) for t in texts]
        begins, ends = predict(encodings)
        return pd.Series([decode_spans(t, int(s), e["offset_mapping"], a, b) for t, s, e, a, b in zip(texts, starts, encodings, begins, ends, strict=True)])

    return ask


def prompted(df: DataFrame, keys: list[str], vocab: dict[str, int], predict: Callable, model: str, text_col: str = "text", prompts: dict[str, str] | None = None,
             max_length: int = MAX_LENGTH, overlap: int = OVERLAP) -> DataFrame:
    """df with `entities` of a model that is asked with a prompt for each category.

    predict(encodings) -> (start probabilities, end probabilities), a row per encoding, as encode_pair makes them.
    """
    rows = None
    for category, prompt in (prompts or PROMPTS).items():
        windows = char_chunks(df.select(*keys, text_col), prompt, text_col, max_length, overlap).where("chunk_text <> ''")

        found = windows.select(*keys, F.explode(asked(prompt, vocab, predict, max_length)("chunk_text", "start")).alias("d"))
        one = found.select(*keys, F.lit(category).alias("category"), F.col("d.start").alias("start"), F.col("d.end").alias("end"), F.col("d.text").alias("text"), F.col("d.score").alias("confidence"), F.lit(model).alias("model"))
        rows = one if rows is None else rows.unionByName(one)
    return gathered(rows, keys, df)


def token_windowed(df: DataFrame, keys: list[str], tokenize: Callable, predict: Callable, model: str, text_col: str = "text", max_tokens: int = MAX_TOKENS, overlap: int = TOKEN_OVERLAP) -> DataFrame:
    """df with `entities` of a token classifier.

    tokenize(text) -> [(start, end)] of its tokens; predict(texts) -> for each window a list of (label, start, end, score). Answers that touch a cut edge
    are dropped: the neighbouring window holds the whole.
    """

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def offsets(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in tokenize(t or "")])

    @F.pandas_udf(PREDICTED)
    def ask(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"label": x, "start": a, "end": b, "score": s} for x, a, b, s in found] for found in predict(list(texts))])

    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = token_chunks(df.select(*keys, text.alias("__text")).withColumn("__o", offsets("__text")), "__o", max_tokens, overlap)
    cut = cut.select(*keys, "__text", "chunk", "chunks", F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"))
    told = cut.withColumn("d", F.explode(ask(F.substring("__text", F.col("chunk_start") + 1, F.col("chunk_end") - F.col("chunk_start")))))
    rows = place(told.select(*keys, "__text", "chunk", "chunks", "chunk_start", "chunk_end", "d.*"), "__text")
    return gathered(rows.withColumn("model", F.lit(model)), keys, df)

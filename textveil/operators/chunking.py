"""Cutting long texts into overlapping windows for models, and putting window results back in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.operators.entities import label_category

# Defaults of the character and the token windows.
MAX_LENGTH, OVERLAP, MOST_CHARS, SPECIAL = 512, 32, 240, 3
MAX_TOKENS, TOKEN_OVERLAP = 510, 64


def windows(length: Column, size: int, overlap: int) -> Column:
    """Array of (start, end) of windows of `size` over `length` items; the last one is the first to reach the end; none for 0."""
    step = size - overlap
    n = F.when(length <= size, 1).otherwise(F.ceil((length - size) / step).cast("int") + 1)
    span = lambda i: F.struct((i * step).cast("int").alias("start"), F.least(i * step + size, length).cast("int").alias("end"))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), n - 1), span)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def char_size(prompt: str, max_length: int = MAX_LENGTH, overlap: int = OVERLAP) -> tuple[int, int]:
    """(window size, overlap) that leave room for the prompt and the special tokens."""
    size = min(max_length - len(prompt) - SPECIAL, MOST_CHARS)
    return size, min(overlap, size - 1)


def char_chunks(df: DataFrame, prompt: str, text_col: str = "text", max_length: int = MAX_LENGTH, overlap: int = OVERLAP) -> DataFrame:
    """A row per window: df's columns, chunk (number), chunk_text, start and end; an empty or null text has one empty window."""
    size, overlap = char_size(prompt, max_length, overlap)
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.when(F.length(text) > 0, windows(F.length(text), size, overlap)).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))))
    out = df.select("*", F.posexplode(spans).alias("chunk", "__w"))
    return out.select(*df.columns, "chunk", F.substring(text, F.col("__w.start") + 1, F.col("__w.end") - F.col("__w.start")).alias("chunk_text"), F.col("__w.start").alias("start"), F.col("__w.end").alias("end"))


def token_chunks(df: DataFrame, offsets_col: str, max_tokens: int = MAX_TOKENS, overlap: int = TOKEN_OVERLAP) -> DataFrame:
    """A row per token window: df's columns, chunk, chunks (how many), start and end in characters, from an array of (start, end) offsets
    of tokens; no tokens, no rows."""
    if not 0 < overlap < max_tokens:
        raise ValueError("overlap must be between 0 and max_tokens")
    offsets = F.col(offsets_col)
    spans = windows(F.size(offsets), max_tokens, overlap)
    out = df.select("*", F.size(spans).alias("chunks"), F.posexplode(spans).alias("chunk", "__w"))
    return out.select(*df.columns, "chunk", "chunks", F.element_at(offsets, F.col("__w.start") + 1)["start"].alias("start"), F.element_at(offsets, F.col("__w.end"))["end"].alias("end"))


def place(predictions: DataFrame, text_col: str = "text") -> DataFrame:
    """Window predictions (chunk, chunks, chunk_start, chunk_end, label, start, end, score) to entities in the whole text.

    Predictions that touch a cut edge of their window are dropped, as are labels of no category; offsets are shifted.
    """
    cut = ((F.col("chunk") > 0) & (F.col("start") == 0)) | ((F.col("chunk") < F.col("chunks") - 1) & (F.col("end") == F.col("chunk_end") - F.col("chunk_start")))
    rows = predictions.where(~cut).withColumn("category", label_category(F.col("label"))).where("category is not null")
    start, end = F.col("chunk_start") + F.col("start"), F.col("chunk_start") + F.col("end")
    rest = [c for c in predictions.columns if c not in ("chunk", "chunks", "chunk_start", "chunk_end", "label", "start", "end", "score", text_col)]
    return rows.select(*rest, "category", start.alias("start"), end.alias("end"), F.substring(F.col(text_col), start + 1, end - start).alias("text"), F.col("score").alias("confidence"))

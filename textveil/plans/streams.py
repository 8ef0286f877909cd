"""Streaming forms over files read as a stream until all are processed; each has a batch equivalent as its oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.operators.detect import exploded
from textveil.plans.common import table
from textveil.plans.documents import FINDINGS, PLANS as DOCUMENT_PLANS
from textveil.sources.io import shared_folder
from textveil.streaming import stream


def _stream(spark, sf_dir, name) -> DataFrame:
    # a file source wants a folder; the glob also matches a single file
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(path + "*")


def _run(df: DataFrame, mode: str = "append") -> DataFrame:
    return stream.run_once(df, f"{shared_folder(df.sparkSession)}/textveil/stream-{uuid.uuid4().hex}", mode)


def stream_mask(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    return _run(stream.mask_stream(docs).select("doc_id", "masked", F.size("findings").cast("bigint").alias("n_findings")))


def stream_window_counts(spark, sf_dir):
    """Findings per day over texts made from events; complete mode, so that the last windows show too."""
    ev = stream.events(_stream(spark, sf_dir, "events"))
    texts = ev.select("event_id", "ts", F.expr("'user' || user_id || '@mail.example.com ' || CASE WHEN event_type = 'error' THEN '10.0.0.' || user_id % 250 ELSE '' END").alias("text"))
    return _run(stream.window_counts(stream.mask_stream(texts), ["event_id"], width="1 day"), "complete")


def stream_ttl_state(spark, sf_dir):
    """Purchases put mappings, errors clear them, clicks get what is live, as in mapping_asof_ttl."""
    ev = stream.events(_stream(spark, sf_dir, "events")).where("event_type in ('purchase', 'error', 'click')")
    kind = F.when(F.col("event_type") == "purchase", "put").when(F.col("event_type") == "error", "clear").otherwise("get")
    rows = ev.select(F.col("user_id").cast("string").alias("session"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_id").alias("generation"), F.col("props").alias("payload"))
    out = _run(stream.live_mappings(rows, ttl=36_000, late="1 hour"))
    return out.select(F.col("session").cast("bigint").alias("user_id"), F.col("seq").alias("event_id"), F.col("generation").alias("mapping_id"))


def stream_newest_generation(spark, sf_dir):
    ev = stream.events(_stream(spark, sf_dir, "events"))
    rows = ev.select("user_id", "ts", F.col("event_id").alias("generation"), F.col("event_type").alias("payload"))
    return _run(stream.newest_generation(rows, "user_id"), "complete")


def stream_findings(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    return _run(exploded(stream.mask_stream(docs), ["doc_id"]).select("doc_id", "category", "start", "end"))


PLANS = {
    "stream_mask": (stream_mask, DOCUMENT_PLANS["mask_documents"][1]),
    "stream_findings": (stream_findings, FINDINGS + """SELECT doc_id, category, "start", "end" FROM f"""),
    "stream_window_counts": (stream_window_counts, """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, category, count(*) AS n FROM (SELECT ts, 'EMAIL' AS category FROM events UNION ALL SELECT ts, 'IP' FROM events WHERE event_type = 'error') GROUP BY 1, 2"""),
    "stream_ttl_state": (stream_ttl_state, DOCUMENT_PLANS["mapping_asof_ttl"][1]),
    "stream_newest_generation": (stream_newest_generation, "SELECT user_id, max(event_id) AS generation, arg_max(event_type, event_id) AS payload FROM events GROUP BY user_id"),
}

"""Streaming: masking each event, mappings that expire, newest-generation-wins, counts per window."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.operators.detect import detect, exploded
from textveil.operators.masking import mask
from textveil.operators.recovery import TTL_SECONDS


def events(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Event time as a TIMESTAMP, which watermarks need; a TIMESTAMP_NTZ is taken in the session's time zone."""
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def mask_stream(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Stateless: each event is detected and masked by itself."""
    return mask(detect(df, text_col, **options), text_col)


def window_counts(masked: DataFrame, keys: list[str], ts_col: str = "ts", width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings per category and tumbling window; events later than the watermark don't count."""
    found = exploded(masked.withWatermark(ts_col, late), [*keys, ts_col])
    return found.groupBy(F.window(ts_col, width), "category").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "category", "n")


STATE = "generation long, payload string, expires_ms long"
LIVE = "session string, ts timestamp, seq long, kind string, generation long, payload string"


def _step(key, state, rows, ttl: int):
    """Rows of one session in event-time order, seq breaking ties; kind: put, clear or get. Yields what each get sees."""
    for r in rows:
        now = int(r.ts.timestamp() * 1000)
        if state is not None and now >= state[2]:
            state = None
        if r.kind == "put":
            # an older generation's mapping comes too late
            if state is None or r.generation >= state[0]:
                state = (int(r.generation), r.payload, now + ttl * 1000)
        elif r.kind == "clear":
            state = None
        else:
            yield (key, r.ts, int(r.seq), "get", state[0] if state else None, state[1] if state else None), state
            continue
        yield None, state


def live_mappings(df: DataFrame, ttl: int = TTL_SECONDS, late: str = "1 minute") -> DataFrame:
    """Stateful: (session, ts, seq, kind, generation, payload) events; for each `get`, the generation and payload live at its time.

    A put replaces the session's mapping unless a newer generation holds; clear drops it; it expires ttl seconds after its put, by the
    event time of what follows and, for idle sessions, by an event-time timer, so that state doesn't outlive its use.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        held = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])  # what one micro-batch holds of one session
        out = []
        for seen, held in _step(key[0], held, rows.itertuples(index=False), ttl):
            if seen:
                out.append(seen)
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
            # a timer may not be set before the watermark
            state.setTimeoutTimestamp(max(int(held[2]), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["session", "ts", "seq", "kind", "generation", "payload"]).astype({"generation": "Int64"})

    return df.withWatermark("ts", late).groupBy("session").applyInPandasWithState(run, LIVE, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def newest_generation(df: DataFrame, key: str) -> DataFrame:
    """Greatest generation per key and its payload, as a streaming aggregate for update or complete mode. State holds one row per
    key for good, as any later event may ask for it; where mappings expire, live_mappings frees theirs."""
    return df.groupBy(key).agg(F.max("generation").alias("generation"), F.max_by("payload", "generation").alias("payload"))


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there now and return the result: each micro-batch is a Parquet folder of its own, which a repeated batch
    overwrites; in complete and update mode the last batch that has rows is the result, or all batches' rows for append."""
    spark, path, written = stream.sparkSession, f"{folder}/rows", []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        written.append(number)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{path}/batch={n}" for n in (sorted(set(written)) if mode == "append" else [max(written)])])

"""Recovery: placeholder mappings with a limited life, and putting originals back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.catalog import CATEGORIES
from textveil.functions.spans import find_all, let
from textveil.operators.masking import mapping

# The form of a placeholder that can be restored, and a mapping's life in seconds.
PLACEHOLDER = "<([A-Z][A-Z0-9_]*)_[1-9][0-9]*>"
TTL_SECONDS = 900


def restore_text(text: Column, names: Column) -> Column:
    """struct(text, restored_count, unknown_count): known categories' placeholders are replaced if mapped, else counted unknown.

    One pass; restored text isn't scanned again. A null mapping restores nothing.
    """
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def scan(held):
        names = held["names"]
        hit = lambda s: F.try_element_at(names, s["value"])

        def step(acc, s):
            gap = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
            return F.struct(s["end"].alias("pos"), F.concat(acc["out"], gap, F.coalesce(hit(s), s["value"])).alias("out"))

        out = F.aggregate(held["spans"], F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
        found = F.size(F.filter(held["spans"], lambda s: hit(s).isNotNull())).cast("bigint")
        return F.struct(out.alias("text"), found.alias("restored_count"), (F.size(held["spans"]).cast("bigint") - found).alias("unknown_count"))

    spans = find_all(text, PLACEHOLDER, key=1, guard=text.contains("<"))
    known = F.filter(spans, lambda s: s["key"].isin(*CATEGORIES))
    return let(F.struct(known.alias("spans"), F.coalesce(names, empty).alias("names")), scan)


def mapping_rows(masked: DataFrame, keys: list[str], findings_col: str = "findings") -> DataFrame:
    """A row per placeholder: keys, placeholder, original."""
    return masked.select(*keys, F.explode(mapping(F.col(findings_col))).alias("placeholder", "original"))


def gather(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per session with its mapping as a map; of several originals of a placeholder the greatest stays."""
    one = rows.groupBy(*keys, "placeholder").agg(F.max("original").alias("original"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("placeholder", "original")))).alias("mapping"))


def restore(replies: DataFrame, mappings: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """replies joined to a map column `mapping` by keys; adds restored, restored_count and unknown_count."""
    out = replies.join(mappings.select(*keys, "mapping"), keys, "left").withColumn("__r", restore_text(F.col(text_col), F.col("mapping")))
    return out.withColumns({"restored": F.col("__r.text"), "restored_count": F.col("__r.restored_count"), "unknown_count": F.col("__r.unknown_count")}).drop("__r", "mapping")


def live_mapping(replies: DataFrame, events: DataFrame, session: str, ts: str, order: str, payload: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """As-of join: for each reply the newest event of its session not after it, if not yet expired and not a tombstone (null payload).

    A mapping made at t lives in [t, t + ttl), so what is live lies in a reply's own ttl-long slot of time or in the one before. Events
    go to their own slot and the next; both sides are merged, and a window per session and slot carries the last event forward. One
    shuffle, no range join, and a session of any length is spread over its slots. Events at one time go by `order`. Adds mapping_id and
    mapping_ts, null without a live mapping.
    """
    slot = lambda c: F.floor(F.col(c).cast("timestamp").cast("double") / ttl).cast("long")
    kind = replies.schema[order].dataType
    sides = events.select(F.col(session).alias("s"), F.col(ts).alias("t"), F.explode(F.array(slot(ts), slot(ts) + 1)).alias("slot"), F.lit(0).alias("side"), F.col(order).alias("o"), F.lit(None).cast(kind).alias("reply"),
                          F.struct(F.col(order).alias("id"), F.col(ts).alias("ts"), F.col(payload).isNotNull().alias("live")).alias("m"))
    asks = replies.select(F.col(session).alias("s"), F.col(ts).alias("t"), slot(ts).alias("slot"), F.lit(1).alias("side"), F.col(order).alias("o"), F.col(order).alias("reply"), F.lit(None).cast(sides.schema["m"].dataType).alias("m"))
    newest_ = F.last("m", ignorenulls=True).over(Window.partitionBy("s", "slot").orderBy("t", "side", "o").rowsBetween(Window.unboundedPreceding, 0))
    out = sides.unionByName(asks).withColumn("m", newest_).where("side = 1")
    live = F.col("m.live") & (F.col("t") < F.col("m.ts") + F.expr(f"INTERVAL {ttl} SECONDS"))
    return out.select(F.col("s").alias(session), F.col("t").alias(ts), F.col("reply").alias(order), F.when(live, F.col("m.id")).alias("mapping_id"), F.when(live, F.col("m.ts")).alias("mapping_ts"))


def newest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key: an aggregate with map-side combine rather than a sort of each key's rows."""
    row = F.struct(*[F.col(c) for c in events.columns])
    return events.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")

"""SQL access: functions on texts, and temporary views over a table with its findings and masked texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.functions.overlaps import resolve
from textveil.functions.spans import let
from textveil.functions.sqltext import sql_text
from textveil.operators.detect import candidates, detect, exploded
from textveil.operators.masking import mapping, mask, replacements, rewrite
from textveil.operators.recovery import restore_text


def create_masked_view(spark: SparkSession, source: str, view: str, text_col: str = "text", **options) -> DataFrame:
    """A view of the table or view `source` with `findings`, `masked` and `mapping` (placeholder -> original)."""
    out = mask(detect(spark.table(source), text_col, **options), text_col).withColumn("mapping", mapping(F.col("findings")))
    out.createOrReplaceTempView(view)
    return out


def create_findings_view(spark: SparkSession, source: str, view: str, keys: list[str], text_col: str = "text", **options) -> DataFrame:
    """A view with a row per finding of the table or view `source`."""
    out = exploded(mask(detect(spark.table(source), text_col, **options), text_col), keys)
    out.createOrReplaceTempView(view)
    return out


def create_restored_view(spark: SparkSession, source: str, view: str, text_col: str = "text", mapping_col: str = "mapping") -> DataFrame:
    """A view of `source`, which holds texts and maps, with `restored`, `restored_count` and `unknown_count`."""
    r = restore_text(F.col(text_col), F.col(mapping_col))
    out = spark.table(source).withColumn("__r", r).select("*", F.col("__r.text").alias("restored"), F.col("__r.restored_count"), F.col("__r.unknown_count")).drop("__r")
    out.createOrReplaceTempView(view)
    return out


def register_functions(spark: SparkSession, dictionary: list[tuple] = (), defaults: dict[str, bool] | None = None) -> list[str]:
    """SQL functions of the session: find_sensitive(text), mask_text(text), mask_mapping(text) and restore_text(text, mapping).

    Their bodies are the library's expressions, which Spark inlines into the query: no Python runs, and nothing is shuffled. A null text
    has no findings and stays null. Names, entities of recognisers and large dictionaries need `detect`. Returns the functions' names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = let(text, lambda t: let(resolve(candidates(t, dictionary, defaults)), lambda f: replacements(t, f)))
    places = F.transform(found, lambda f: F.struct(f["category"].alias("category"), f["start"].alias("start"), f["end"].alias("end"), f["value"].alias("value"), f["replacement"].alias("replacement")))
    bodies = {
        "find_sensitive": ("text STRING", "ARRAY<STRUCT<category: STRING, start: INT, end: INT, value: STRING, replacement: STRING>>", places),
        "mask_text": ("text STRING", "STRING", F.when(F.col("text").isNotNull(), let(found, lambda f: rewrite(text, f)))),
        "mask_mapping": ("text STRING", "MAP<STRING, STRING>", let(found, mapping)),
        "restore_text": ("text STRING, names MAP<STRING, STRING>", "STRING", F.when(F.col("text").isNotNull(), restore_text(text, F.col("names"))["text"])),
    }
    for name, (arguments, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {sql_text(body)}")
    return list(bodies)

"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.sources.io import spread


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, or some columns of it; tables of texts are dealt out to all cores if they come in fewer splits."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if "text" in df.columns or "html" in df.columns else df


def literal(value) -> str:
    """A Python value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    out = str(value).replace("'", "''")
    # control characters can't stand in a plain literal of every engine
    for c in sorted({c for c in out if c in "\n\r\t"}):
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return f"('{out}')" if "||" in out else f"'{out}'"


def values_sql(rows: list[tuple], columns: str) -> str:
    """SELECT over VALUES; columns as in "id BIGINT, text VARCHAR"."""
    parts = [c.strip().rsplit(" ", 1) if not c.strip().endswith("]") else c.strip().split(" ", 1) for c in columns.split(",")]
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows) or "(" + ", ".join(["NULL"] * len(parts)) + ")"
    chosen = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in parts)
    return f"SELECT {chosen} FROM (VALUES {body}) t({', '.join(n for n, _ in parts)})" + ("" if rows else " WHERE false")


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def spans_sql(source: str, keys: str, text: str, pattern: str, keep: str = "true", group: int = 0) -> str:
    """Rows (keys, start, end, value) of a pattern's matches, for patterns whose engine is the oracle's: offsets are running lengths
    of the pieces between matches and of the matches."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
WITH src AS ({source}),
hits AS (SELECT {keys}, regexp_extract_all({text}, {p}) AS m, regexp_split_to_array({text}, {p}) AS g FROM src WHERE regexp_matches({text}, {p})),
each AS (SELECT {keys}, m, g, unnest(generate_series(1, len(m))) AS i FROM hits),
placed AS (SELECT {keys}, CAST(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS "start", m[i] AS value FROM each)
SELECT {keys}, "start", "start" + len(value) AS "end", value FROM placed WHERE {keep}"""


def span_rows(df: DataFrame, spans, *keys: str) -> DataFrame:
    """A row per span: keys, start, end, value."""
    rows = df.select(*keys, F.explode(spans).alias("s"))
    return rows.select(*keys, F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"), F.col("s.value").alias("value"))

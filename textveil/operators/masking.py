"""Masking: numbered placeholders for selected findings, within a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.catalog import CANDIDATES, none_of
from textveil.functions.spans import let, once

# Fixed value: what a text already holds in the form of a placeholder keeps its number from being used.
RESERVED = "<[A-Z][A-Z0-9_]*_[0-9]+>"
REPLACED = CANDIDATES.replace("ord:int", "ord:int,replacement:string")


def reserved(text: Column) -> Column:
    """Placeholders that stand in the original text."""
    return F.regexp_extract_all(text, F.lit(RESERVED), F.lit(0))


def free_number(taken: Column, n: Column) -> Column:
    """The n-th positive integer that isn't in the array."""
    return F.element_at(F.array_except(F.sequence(F.lit(1), n + F.size(taken)), taken), n)


def replacements(text: Column, findings: Column) -> Column:
    """Findings (by start) with `replacement`.

    A key is (category, value without case); keys of a category are numbered in order of their first selected finding, skipping
    reserved numbers. A finding before its key's first selected one, or of a key without any, has the empty replacement.
    One pass over the findings carries the keys numbered so far.
    """
    state = "struct<keys:array<struct<c:string,v:string,label:string>>,out:" + REPLACED + ">"

    def numbers(marks, category):
        # only the plain form <CATEGORY_n> without leading zeros can clash
        head = F.concat(F.lit("<"), category, F.lit("_"))
        rest = F.transform(F.filter(marks, lambda p: p.startswith(head)), lambda p: F.substring(p, F.length(head) + 1, F.length(p)))
        return F.array_distinct(F.transform(F.filter(rest, lambda p: p.rlike("^[1-9][0-9]{0,8}>$")), lambda p: F.regexp_replace(p, ">", "").cast("int")))

    def fill(marks):
        def step(acc, f):
            folded = F.lower(f["value"])
            held = F.filter(acc["keys"], lambda k: (k["c"] == f["category"]) & (k["v"] == folded))

            def add(held):
                n = F.size(F.filter(acc["keys"], lambda k: k["c"] == f["category"])) + 1
                fresh = F.concat(F.lit("<"), f["category"], F.lit("_"), free_number(numbers(marks, f["category"]), n).cast("string"), F.lit(">"))
                label = F.when(F.size(held) > 0, F.try_element_at(held, F.lit(1))["label"]).when(f["selected"], fresh).otherwise("")
                return let(label, lambda name: F.struct(
                    F.when((F.size(held) == 0) & f["selected"], F.concat(acc["keys"], F.array(F.struct(f["category"].alias("c"), folded.alias("v"), name.alias("label"))))).otherwise(acc["keys"]).alias("keys"),
                    F.concat(acc["out"], F.array(F.struct(*[f[c].alias(c) for c in ("category", "start", "end", "value", "source", "selected", "ord")], name.alias("replacement")))).alias("out")).cast(state))

            return let(held, add)

        start = F.struct(F.array().cast("array<struct<c:string,v:string,label:string>>").alias("keys"), none_of(REPLACED).alias("out")).cast(state)
        return F.aggregate(findings, start, step, lambda acc: acc["out"])

    marks = F.when(text.contains("<"), reserved(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(findings) > 0, let(marks, fill)).otherwise(none_of(REPLACED))


def rewrite(text: Column, replaced: Column) -> Column:
    """The text with selected findings replaced; findings are by start and don't overlap."""

    def step(acc, f):
        gap = F.substring(text, acc["pos"] + 1, f["start"] - acc["pos"])
        return F.struct(f["end"].alias("pos"), F.concat(acc["out"], gap, F.when(f["selected"], f["replacement"]).otherwise(f["value"])).alias("out"))

    done = F.aggregate(replaced, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(replaced) > 0, done).otherwise(text)


def mask(found: DataFrame, text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """found with its findings replaced ones (`findings` with replacement) and `masked`, the rewritten text."""
    out = found.withColumn(findings_col, once(replacements(F.col(text_col), F.col(findings_col))))
    return out.withColumn("masked", once(rewrite(F.col(text_col), F.col(findings_col))))


def mapping(replaced: Column) -> Column:
    """Map placeholder -> original of selected findings with a replacement; the last original of a placeholder stays."""

    def build(used):
        names = F.array_distinct(F.transform(used, lambda f: f["replacement"]))
        last = lambda n: F.element_at(F.filter(used, lambda f: f["replacement"] == n), -1)["value"]
        return F.map_from_arrays(names, F.transform(names, lambda n: last(n)))

    return let(F.filter(replaced, lambda f: f["selected"] & (f["replacement"] != "")), build)

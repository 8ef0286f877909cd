"""Detection: candidates of rules, dictionary, names and given entities; overlaps resolved; one array per text.

All of it is within a row, so nothing is shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.catalog import CANDIDATE, CANDIDATES, default_selected, none_of, risk
from textveil.functions.overlaps import numbered, resolve
from textveil.functions.rules import DIGIT, RULES, Text, folds_oddly, rule_candidates
from textveil.functions.spans import find_all, once

#: Dictionary terms that one plan's expressions hold; larger dictionaries are matched by `dictionary_udf`.
INLINE_TERMS = 64
#: Terms that travel with the function at most.
MOST_TERMS = 1_000_000


def term_pattern(term: str) -> str:
    """A term as a pattern: without case, and on word limits if it is made of ASCII letters, digits and underscores."""
    quoted = r"(?iu)\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"
    if re.fullmatch(r"[A-Za-z0-9_]+", term):
        quoted = rf"(?iu)(?<![A-Za-z0-9_])(?:{term})(?![A-Za-z0-9_])"
    return quoted


def ordered(dictionary: list[tuple]) -> list[tuple]:
    """(term, category, selected or None), longest term first, in order of entry for equal lengths, without empty terms."""
    rows = [(e[0], e[1].upper(), e[2] if len(e) > 2 else None) for e in dictionary if e[0]]
    return sorted(rows, key=lambda e: -len(e[0]))


def dictionary_candidates(text: Column, dictionary: list[tuple], defaults: dict[str, bool] | None = None) -> Column:
    """Candidates of all terms, longest term first."""
    terms = ordered(dictionary)
    if len(terms) > INLINE_TERMS:
        found = dictionary_udf(terms)(text)
        chosen = lambda s: F.coalesce(s["selected"], default_selected(s["category"], defaults))
        made = F.transform(found, lambda s: F.struct(s["category"].alias("category"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit("dictionary").alias("source"), chosen(s).alias("selected"), F.lit(0).alias("ord")).cast(CANDIDATE))
        return F.coalesce(made, none_of(CANDIDATES))
    out = none_of(CANDIDATES)
    for term, category, selected in terms:
        chosen = F.lit(selected) if selected is not None else default_selected(F.lit(category), defaults)
        hint = F.lower(text).contains(term.lower()) if term.isascii() else None
        spans = find_all(text, term_pattern(term), guard=hint)
        out = F.concat(out, _proposed(spans, F.lit(category), chosen))
    return out


def _proposed(spans: Column, category: Column, chosen: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(category.alias("category"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                                                 F.lit("dictionary").alias("source"), chosen.alias("selected"), F.lit(0).alias("ord")).cast(CANDIDATE))


def dictionary_udf(terms: list[tuple]):
    """Arrow function for large dictionaries: per text, the occurrences of each term, in the terms' order.

    One pass over a text looks up the two folded characters at every place; only where some term begins so are its lengths looked
    up. So the work follows the text rather than the number of terms, of which MOST_TERMS are taken at most: they travel
    with the function.
    """
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    kind = "array<struct<category:string,start:int,end:int,value:string,selected:boolean>>"

    @F.pandas_udf(kind)
    def find(texts: pd.Series) -> pd.Series:
        # a term may be entered more than once; each entry proposes spans
        by_text: dict[str, list[int]] = {}
        for i, (term, _, _) in enumerate(terms):
            by_text.setdefault(term.lower(), []).append(i)
        heads: dict[str, list[int]] = {}
        for t in by_text:
            heads.setdefault(t[:2], []).append(len(t))
        heads = {h: sorted(set(n)) for h, n in heads.items()}
        word = re.compile(r"[A-Za-z0-9_]")
        plain = [re.fullmatch(r"[A-Za-z0-9_]+", t) is not None for t, _, _ in terms]

        def one(text):
            if text is None:
                return []
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            until: dict[int, int] = {}
            found = []
            for at in range(len(low)):
                pair = low[at : at + 2]
                lengths = (*heads.get(pair[:1], ()), *(heads.get(pair, ()) if len(pair) == 2 else ()))
                for n in lengths:
                    for i in by_text.get(low[at : at + n], ()) if at + n <= len(low) else ():
                        if at < until.get(i, 0):
                            continue
                        if plain[i] and ((at and word.match(low[at - 1])) or (at + n < len(low) and word.match(low[at + n]))):
                            continue
                        until[i] = at + n
                        found.append((i, at, n))
            found.sort()
            return [{"category": terms[i][1], "start": at, "end": at + n, "value": text[at : at + n], "selected": terms[i][2]} for i, at, n in found]

        return texts.map(one)

    return find


def from_entities(entities: Column, source: str, defaults: dict[str, bool] | None = None) -> Column:
    """Candidates from an array of (category, start, end, text): already validated findings of a recogniser."""
    return F.transform(entities, lambda e: F.struct(
        e["category"].alias("category"), e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("value"), F.lit(source).alias("source"),
        default_selected(e["category"], defaults).alias("selected"), F.lit(0).alias("ord")).cast(CANDIDATE))


def candidates(text: Column | Text, dictionary: list[tuple] = (), defaults: dict[str, bool] | None = None, extra: Column | None = None, rules=RULES) -> Column:
    """All candidates of a text, numbered: rules in their order, dictionary, extra ones as given."""
    text = text if isinstance(text, Text) else Text(text)
    parts = [rule_candidates(text, defaults, rules)]
    if dictionary:
        parts.append(dictionary_candidates(text.text, list(dictionary), defaults))
    if extra is not None:
        parts.append(F.coalesce(extra, none_of(CANDIDATES)))
    return numbered(F.concat(*parts))


def detect(df: DataFrame, text_col: str = "text", dictionary: list[tuple] = (), defaults: dict[str, bool] | None = None, extra_col: str | None = None, names: bool = False) -> DataFrame:
    """df with `findings`: the resolved candidates of each text, by start. names adds the rule-based person detector."""
    extra = F.col(extra_col) if extra_col else None
    if names:
        from textveil.operators.entities import name_candidates

        df = name_candidates(df, text_col, "__names", defaults)
        extra = F.col("__names") if extra is None else F.concat(F.coalesce(extra, none_of(CANDIDATES)), "__names")
    df = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumns({"__low": once(F.lower("__text")), "__digit": once(F.col("__text").rlike(DIGIT)), "__odd": once(folds_oddly(F.col("__text")))})
    df = df.withColumn("findings", once(candidates(Text(F.col("__text"), F.col("__low"), F.col("__digit"), F.col("__odd")), dictionary, defaults, extra)))
    out = df.withColumn("findings", once(resolve(F.col("findings")))).drop("__text", "__low", "__digit", "__odd")
    return out.drop("__names")


def exploded(found: DataFrame, keys: list[str], column: str = "findings") -> DataFrame:
    """A row per finding: keys, finding_id, category, start, end, value, source, risk, selected, and replacement if known."""
    rows = found.select(*keys, F.explode(column).alias("f"))
    fields = ["category", "start", "end", "value", "source", "selected"]
    more = [F.col("f.replacement")] if "replacement" in found.schema[column].dataType.elementType.names else []
    return rows.select(*keys, F.concat_ws(":", "f.category", F.col("f.start").cast("string"), F.col("f.end").cast("string")).alias("finding_id"),
                       *[F.col(f"f.{c}").cast("bigint").alias(c) if c in ("start", "end") else F.col(f"f.{c}") for c in fields], risk(F.col("f.category")).alias("risk"), *more)


def high_risk_only(findings: Column) -> Column:
    """Selection: exactly the findings of high risk."""
    return F.transform(findings, lambda f: f.withField("selected", risk(f["category"]) == "high"))


def toggle(findings: Column, category: Column, value: Column, selected: Column) -> Column:
    """Selection of all findings of one group (category, value without case)."""
    return F.transform(findings, lambda f: f.withField("selected", F.when((f["category"] == category) & (F.lower(f["value"]) == F.lower(value)), selected).otherwise(f["selected"])))


def unmasked_high_risk(findings: Column) -> Column:
    """Sorted distinct categories of high risk that aren't selected."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(findings, lambda f: (risk(f["category"]) == "high") & ~f["selected"]), lambda f: f["category"])))

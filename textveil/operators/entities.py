"""From a recogniser's raw entities to findings: validation, splitting, extra names, and spreading to other occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.catalog import CANDIDATE, CANDIDATES, default_selected, none_of
from textveil.functions.spans import find_all, let
from textveil.operators.names import ENTITY, TECHNICAL_TERMS, names_udf

# Fixed values of entity handling.
ENTITY_CATEGORIES = ("PERSON", "ORG")
PERSON_ORG_SUFFIXES = ("有限责任公司", "股份有限公司", "有限公司", "实验室", "研究院", "数据中心", "研发中心")
ROLE_LABEL = r"(?iu)(?:负责人|项目负责人|联系人|审核人|审批人|申请人|开发人员|operator|owner|reviewer|approver|name)[\s\p{Z}]*(?:[:：=][\s\p{Z}]*|是[\s\p{Z}]*|为[\s\p{Z}]*)?$"
ROLE_CHARS = 24
HE_NAME = r"(?<![\x{4E00}-\x{9FFF}])何[\x{4E00}-\x{9FFF}]{2}(?=反馈|联系|负责|提交|确认|处理|回复)"
LEGAL_FORM = r"^[\x{4E00}-\x{9FFF}]{0,12}(?:有限责任公司|股份有限公司|有限公司)"
LEGAL_CHARS = 20
ORG_LEADS = "在是与和向由到给为对从将把请"
CJK_CHAR = r"^[\x{4E00}-\x{9FFF}]$"
LABELS = {
    "人名": "PERSON", "组织机构": "ORG", "组织": "ORG", "per": "PERSON", "org": "ORG",
    "name": "PERSON", "company": "ORG", "government": "ORG", "organization": "ORG",
}


def label_category(label: Column) -> Column:
    """Category of a recogniser's label, whatever its case and with a B- or I- before it; null for others."""
    table = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.regexp_replace(label, "^[BI]-", "")))


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def split_persons(entities: Column) -> Column:
    """A PERSON with white space in it becomes its runs of other characters, with shifted offsets and the same confidence."""
    blank = r"[\s\p{Z}\x1C-\x1F\x85]"

    def parts(e):
        runs = find_all(e["text"], r"[^\s\p{Z}\x1C-\x1F\x85]+", guard=F.lit(True))
        made = F.transform(runs, lambda r: F.struct(e["category"].alias("category"), (e["start"] + r["start"]).alias("start"), (e["start"] + r["end"]).alias("end"), r["value"].alias("text"), e["confidence"].alias("confidence"), e["model"].alias("model")))
        return F.when((F.upper(e["category"]) == "PERSON") & e["text"].rlike(blank), made).otherwise(F.array(e))

    return F.flatten(F.transform(entities, parts))


def threshold(model: Column, category: Column, thresholds: dict[str, dict[str, float]]) -> Column:
    """The least confidence for a model's category, 0 if none is set."""
    pairs = [x for m, by in thresholds.items() for c, v in by.items() for x in (F.lit(f"{m}\x00{c}"), F.lit(float(v)))]
    if not pairs:
        return F.lit(0.0)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat(F.coalesce(model, F.lit("")), F.lit("\x00"), category)), F.lit(0.0))


def valid(text: Column, e: Column, thresholds: dict[str, dict[str, float]] | None = None) -> Column:
    """Whether an entity is usable: category, offsets and text agree with the source; no technical term as a person without a role before
    it; no organisation as a person; a finite confidence in [0, 1] that reaches the threshold."""
    category = F.upper(e["category"])
    inside = (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text)) & (slice_of(text, e["start"], e["end"]) == e["text"])
    from_ = F.greatest(e["start"] - ROLE_CHARS, F.lit(0))
    named = slice_of(text, from_, e["start"]).rlike(ROLE_LABEL)
    org = F.lit(False)
    for s in PERSON_ORG_SUFFIXES:
        org = org | e["text"].endswith(s)
    person = (category == "PERSON") & ((e["text"].isin(*TECHNICAL_TERMS) & ~named) | org)
    sure = e["confidence"].isNotNull() & ~F.isnan(e["confidence"]) & e["confidence"].between(0.0, 1.0) & (e["confidence"] >= threshold(e["model"], category, thresholds or {}))
    return F.coalesce(category.isin(*ENTITY_CATEGORIES) & inside & ~person & sure, F.lit(False))


def _made(category: Column, start: Column, end: Column, value: Column, source: str, defaults) -> Column:
    return F.struct(category.alias("category"), start.alias("start"), end.alias("end"), value.alias("value"), F.lit(source).alias("source"), default_selected(category, defaults).alias("selected"), F.lit(0).alias("ord")).cast(CANDIDATE)


def he_names(text: Column, findings: Column, source: str, defaults=None) -> Column:
    """Three-character names with 何 before an action verb, where a model found nothing; for models only."""
    if source != "entity_model":
        return none_of(CANDIDATES)
    free = F.filter(find_all(text, HE_NAME, guard=text.contains("何")), lambda s: ~F.exists(findings, lambda f: (s["end"] > f["start"]) & (s["start"] < f["end"])))
    return F.transform(free, lambda s: _made(F.lit("PERSON"), s["start"], s["end"], s["value"], source, defaults))


def occurrences(text: Column, value: Column) -> Column:
    """Start offsets of the non-overlapping exact occurrences of a value; split() by it leaves the pieces between."""
    # \E inside a value would end the quoting
    literal = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.split(text, literal, -1)
    state = "struct<pos:int,out:array<int>>"
    step = lambda acc, p: F.struct((acc["pos"] + F.length(p) + F.length(value)).alias("pos"), F.concat(acc["out"], F.array(acc["pos"] + F.length(p))).alias("out")).cast(state)
    whole = F.aggregate(pieces, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")).cast(state), step, lambda acc: acc["out"])
    # the end of the last piece is no occurrence
    return F.slice(whole, F.lit(1), F.size(whole) - 1)


def safe_boundary(text: Column, category: Column, value: Column, start: Column, end: Column) -> Column:
    """No spreading into a longer expression: doubled edge characters or a legal form after a person, a CJK lead before an organisation."""
    before, after = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise(""), F.substring(text, end + 1, F.lit(1))
    person = (before != F.substring(value, 1, 1)) & (after != F.substring(value, F.length(value), F.lit(1))) & ~F.substring(text, end + 1, F.lit(LEGAL_CHARS)).rlike(LEGAL_FORM)
    org = ~(before.rlike(CJK_CHAR) & ~F.lit(ORG_LEADS).contains(before))
    return F.when(category == "PERSON", person).otherwise(org)


def shadowed(category: Column, start: Column, end: Column, findings: Column) -> Column:
    """A longer finding of the category covers the span."""
    return F.exists(findings, lambda o: (o["category"] == category) & (o["start"] <= start) & (end <= o["end"]) & (o["end"] - o["start"] > end - start))


def spread(text: Column, findings: Column) -> Column:
    """Findings and the further exact occurrences of those that no longer one covers. Shadows are cast by
    the given findings only."""

    def grow(given):
        seeds = F.filter(given, lambda f: f["category"].isin(*ENTITY_CATEGORIES) & f["source"].isin("entity_model", "lightweight_person") & ~shadowed(f["category"], f["start"], f["end"], given))
        def more(seed):
            spans = F.transform(occurrences(text, seed["value"]), lambda at: F.struct(at.alias("start"), (at + F.length(seed["value"])).alias("end")))
            free = F.filter(spans, lambda s: ~F.exists(given, lambda o: (o["category"] == seed["category"]) & (o["start"] == s["start"]) & (o["end"] == s["end"]))
                            & ~shadowed(seed["category"], s["start"], s["end"], given) & safe_boundary(text, seed["category"], seed["value"], s["start"], s["end"]))
            return F.transform(free, lambda s: F.struct(seed["category"].alias("category"), s["start"].alias("start"), s["end"].alias("end"), seed["value"].alias("value"), seed["source"].alias("source"), seed["selected"].alias("selected"), F.lit(0).alias("ord")).cast(CANDIDATE))

        added = F.flatten(F.transform(seeds, lambda x: more(x)))
        fresh = lambda xs: F.aggregate(xs, none_of(CANDIDATES), lambda acc, x: F.when(F.exists(acc, lambda o: (o["category"] == x["category"]) & (o["start"] == x["start"]) & (o["end"] == x["end"])), acc).otherwise(F.concat(acc, F.array(x))))
        return F.concat(given, fresh(added))

    return F.when(F.size(findings) > 0, let(findings, grow)).otherwise(none_of(CANDIDATES))


def to_findings(text: Column, entities: Column, source: str = "entity_model", defaults: dict[str, bool] | None = None, thresholds: dict[str, dict[str, float]] | None = None) -> Column:
    """Candidates from raw entities: split, validated, completed with 何 names, spread to other occurrences."""
    entities = F.coalesce(entities, none_of(ENTITY))
    good = F.filter(split_persons(entities), lambda e: valid(text, e, thresholds))
    made = F.transform(good, lambda e: _made(F.upper(e["category"]), e["start"], e["end"], e["text"], source, defaults))
    return spread(text, let(made, lambda m: F.concat(m, he_names(text, m, source, defaults))))


def name_candidates(df: DataFrame, text_col: str, out_col: str, defaults: dict[str, bool] | None = None) -> DataFrame:
    """df with candidates of the name detector, spread; and the 何 names that hold even without a model."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("__entities", names_udf()(text))
    model = to_findings(text, none_of(ENTITY), "entity_model", defaults)
    return df.withColumn(out_col, F.concat(model, to_findings(text, F.col("__entities"), "lightweight_person", defaults))).drop("__entities")


def locate_tagged(text: Column, tagged: Column) -> Column:
    """Entities from (value, label) pairs in order: each is searched from the end of the one before, else from the start, else dropped. The
    place moves on for every value found, whatever its label; confidence is null."""
    state = f"struct<pos:int,out:{ENTITY}>"

    def step(acc, t):
        ahead = F.call_function("locate", t["value"], text, acc["pos"] + 1)
        at = F.when(ahead > 0, ahead).otherwise(F.call_function("locate", t["value"], text, F.lit(1))) - 1
        hit = (F.length(t["value"]) > 0) & (at >= 0)
        category = label_category(t["label"])
        e = F.struct(category.alias("category"), at.alias("start"), (at + F.length(t["value"])).alias("end"), t["value"].alias("text"), F.lit(None).cast("double").alias("confidence"), F.lit("tagger").alias("model"))
        return F.struct(F.when(hit, at + F.length(t["value"])).otherwise(acc["pos"]).alias("pos"), F.when(hit & category.isNotNull(), F.concat(acc["out"], F.array(e))).otherwise(acc["out"]).alias("out")).cast(state)

    return F.aggregate(tagged, F.struct(F.lit(0).alias("pos"), none_of(ENTITY).alias("out")).cast(state), step, lambda acc: acc["out"])


def best_per_span(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, category, start, end, text): that of the greatest confidence, null counting as 0; the first model for ties."""
    order = Window.partitionBy(*keys, "category", "start", "end", "text").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "model")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")

"""Settings blobs: JSON validated field by field, each invalid field replaced by its default; unreadable ones are set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.catalog import CATEGORIES, DEFAULTS

# Defaults of the scalar settings.
HOTKEY, WARNING, STARTUP = "<ctrl>+<shift>+s", True, False
FIELDS = ("dictionary", "hotkey", "high_risk_warning", "category_defaults", "startup")
ENTRY = "array<struct<term:string,category:string,default_selected:boolean>>"


def _flag(text: Column) -> Column:
    """A JSON literal true or false; null for anything else, such as the string "true"."""
    return F.when(text == "true", True).when(text == "false", False)


def readable(raw: Column) -> Column:
    """The blob is a JSON object."""
    parsed = F.from_json(raw, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.ltrim(raw).startswith("{") & parsed.isNotNull() & F.json_object_keys(raw).isNotNull(), F.lit(False))


def members(raw: Column) -> Column:
    """Top-level members of an object as raw JSON; strings keep their quotes."""
    return F.from_json(raw, "map<string,variant>")


def _literals(raw: Column, field: str) -> Column:
    """A member as JSON text, null if absent; strings are quoted, so "true" and true differ."""
    return F.to_json(F.try_element_at(members(raw), F.lit(field)))


def valid_dictionary(json: Column) -> Column:
    """Entries with a non-blank term, a known category and a boolean flag; anything but a list gives none."""
    items = F.from_json(F.when(json.startswith("["), json), "array<variant>")
    text = lambda v, f: F.try_variant_get(v, f"$.{f}", "string")
    is_kind = lambda v, f, kind: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) == kind
    ok = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT") & is_kind(v, "term", "STRING") & (F.regexp_replace(text(v, "term"), r"[\s\p{Z}\x1C-\x1F\x85]", "") != "")
                              & is_kind(v, "category", "STRING") & text(v, "category").isin(*CATEGORIES) & is_kind(v, "default_selected", "BOOLEAN"), F.lit(False))
    made = lambda v: F.struct(text(v, "term").alias("term"), text(v, "category").alias("category"), F.try_variant_get(v, "$.default_selected", "boolean").alias("default_selected"))
    return F.coalesce(F.transform(F.filter(items, ok), made), F.array().cast(ENTRY))


def valid_defaults(json: Column) -> Column:
    """Known categories with a boolean value; anything but an object gives none."""
    entries = F.from_json(F.when(json.startswith("{"), json), "map<string,variant>")
    good = F.map_filter(entries, lambda k, v: F.coalesce(k.isin(*CATEGORIES) & (F.schema_of_variant(v) == "BOOLEAN"), F.lit(False)))
    return F.coalesce(F.transform_values(good, lambda k, v: F.try_variant_get(v, "$", "boolean")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<boolean>")))


def merged(base: Column, over: Column) -> Column:
    """Map of both, `over` winning."""
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))
    return F.map_concat(rest, over)


def default_map() -> Column:
    return F.create_map(*[F.lit(x) for c, v in DEFAULTS.items() for x in (c, v)])


def load(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """df with dictionary, hotkey, high_risk_warning, category_defaults, startup and corrupt (the blob wasn't an object)."""
    raw = F.col(raw_col)
    good = F.when(readable(raw), raw)
    field = {f: _literals(good, f) for f in FIELDS}
    hotkey = F.when(field["hotkey"].startswith('"') & (F.length(field["hotkey"]) > 2), F.try_variant_get(F.try_element_at(members(good), F.lit("hotkey")), "$", "string"))
    return df.withColumns({
        "corrupt": ~readable(raw),
        "dictionary": valid_dictionary(field["dictionary"]),
        "hotkey": F.coalesce(hotkey, F.lit(HOTKEY)),
        "high_risk_warning": F.coalesce(_flag(field["high_risk_warning"]), F.lit(WARNING)),
        "category_defaults": merged(default_map(), valid_defaults(field["category_defaults"])),
        "startup": F.coalesce(_flag(field["startup"]), F.lit(STARTUP)),
    })

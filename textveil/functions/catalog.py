"""Categories with risk, priority and default selection, and the record types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category -> (risk, priority, selected by default).
CATEGORIES = {
    "DB_CREDENTIAL": ("high", 1, True),
    "PASSWORD": ("high", 2, True),
    "SECRET": ("high", 2, True),
    "API_KEY": ("high", 2, True),
    "TOKEN": ("high", 2, True),
    "ID_CARD": ("high", 3, True),
    "PHONE": ("high", 3, True),
    "EMAIL": ("high", 3, True),
    "BANK_CARD": ("high", 4, True),
    "URL": ("medium", 4, True),
    "IP": ("medium", 5, True),
    "DOMAIN": ("medium", 5, True),
    "PERSON": ("medium", 6, True),
    "CUSTOMER": ("medium", 6, True),
    "PROJECT": ("medium", 6, True),
    "ID": ("medium", 6, True),
    "DEPARTMENT": ("low", 6, False),
    "SYSTEM": ("low", 6, False),
    "ORG": ("medium", 7, True),
    "TABLE_NAME": ("low", 7, False),
    "FIELD_NAME": ("low", 7, False),
}
SOURCES = {"rule": 1, "dictionary": 2, "entity_model": 3, "lightweight_person": 4}
OTHER_PRIORITY, OTHER_RISK, OTHER_SOURCE = 7, "low", 9
DEFAULTS = {c: v[2] for c, v in CATEGORIES.items()}

#: What a rule, dictionary or recogniser proposes; ord keeps the order of proposal.
CANDIDATE = "struct<category:string,start:int,end:int,value:string,source:string,selected:boolean,ord:int>"
CANDIDATES = f"array<{CANDIDATE}>"


def none_of(kind: str) -> Column:
    """An empty array of the type."""
    return F.array().cast(kind)


def _lookup(values: dict, key: Column, other) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, key), F.lit(other))


def risk(category: Column) -> Column:
    return _lookup({c: v[0] for c, v in CATEGORIES.items()}, category, OTHER_RISK)


def priority(category: Column) -> Column:
    return _lookup({c: v[1] for c, v in CATEGORIES.items()}, category, OTHER_PRIORITY)


def source_priority(source: Column) -> Column:
    return _lookup(SOURCES, source, OTHER_SOURCE)


def known(category: Column) -> Column:
    return F.coalesce(category.isin(*CATEGORIES), F.lit(False))


def default_selected(category: Column, defaults: dict[str, bool] | None = None) -> Column:
    """User's default, else the catalogue's, else not selected."""
    return _lookup(DEFAULTS | (defaults or {}), category, False)

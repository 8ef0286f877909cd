"""Name -> query and name -> oracle SQL of the library's own operators."""

from __future__ import annotations

from textveil.plans import documents, entities, evaluation, rules, streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (rules, documents, entities, evaluation, streams):
    for _name, (_query, _sql) in _part.PLANS.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLES[_name] = _sql

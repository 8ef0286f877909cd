"""Greedy choice among overlapping intervals, within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions.catalog import CANDIDATE, CANDIDATES, none_of, priority, source_priority


def numbered(candidates: Column) -> Column:
    """Candidates with ord set to their place in the array."""
    return F.transform(candidates, lambda c, i: F.struct(*[c[x].alias(x) for x in ("category", "start", "end", "value", "source", "selected")], i.alias("ord")).cast(CANDIDATE))


def choose(items: Column, rank: list, kind: str) -> Column:
    """Accept items in order of rank(item) expressions if disjoint from all accepted; by start.

    Items have start and end; an empty span inside an accepted one overlaps it, at its edge it doesn't. The order is
    total if the last rank is unique.
    """
    keyed = F.transform(items, lambda c: F.struct(*[f(c).alias(f"r{i}") for i, f in enumerate(rank)], c.alias("c")))

    def take(acc, x):
        free = ~F.exists(acc, lambda k: (x["c"]["end"] > k["start"]) & (x["c"]["start"] < k["end"]))
        return F.when(free, F.concat(acc, F.array(x["c"]))).otherwise(acc)

    accepted = F.aggregate(F.array_sort(keyed), none_of(kind), take)
    by_start = F.array_sort(F.transform(accepted, lambda c, i: F.struct(c["start"].alias("start"), i.alias("i"), c.alias("c"))))
    return F.transform(by_start, lambda x: x["c"])


def resolve(candidates: Column) -> Column:
    """Non-overlapping candidates by priority of category, length of a person, source, length, place, models' organisations, ord."""
    size = lambda c: c["end"] - c["start"]
    rank = [
        lambda c: priority(c["category"]),
        lambda c: F.when(c["category"] == "PERSON", -size(c)).otherwise(0),
        lambda c: source_priority(c["source"]),
        lambda c: -size(c),
        lambda c: c["start"],
        lambda c: F.when((c["source"] == "entity_model") & (c["category"] == "ORG"), 0).otherwise(1),
        lambda c: c["ord"],
    ]
    return choose(candidates, rank, CANDIDATES)

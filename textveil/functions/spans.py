"""Spans of pattern matches with code-point offsets, in Column expressions.

The pieces that split() leaves and the matches that regexp_extract_all() gives alternate, so running lengths are
offsets; Spark's own position functions would count UTF-16 units or find only the first match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textveil.functions.catalog import none_of

SPAN = "struct<start:int,end:int,value:string,key:string,at:int>"
SPANS = f"array<{SPAN}>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda an expression would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def once(value: Column) -> Column:
    """value, with a condition that always holds and that the optimizer can't see through: filters and projections above
    refer to the column instead of each getting a copy of an expensive expression. A comparison of rand() itself would be simplified away."""
    return F.when(F.rand(0) + 1 > 0, value)


def _blocks(rows: Column, size: int) -> Column:
    """An array cut into arrays of `size`; each cut reads all of rows."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(rows) - 1) / size)).cast("int"))
    return F.transform(starts, lambda i: F.slice(rows, i * size + 1, F.lit(size)))


def scan(rows: Column, zero: Column, step, item, kind: str = "int", blocks: tuple[int, int] = (1 << 14, 128)) -> Column:
    """Array of item(carry, x) for each x of an array, where carry is `zero` after step(carry, x) of all before x, of type `kind`.

    Spark's aggregate copies what it has gathered at each element, and slice reads the array it cuts. So carries alone are
    gathered, in blocks of blocks: the work is in proportion to the array for up to some millions of elements, and not
    to its square. The items are made of rows and carries side by side.
    """
    none = none_of(f"array<{kind}>")

    def one(acc, x):
        return F.struct(step(acc["carry"], x).alias("carry"), F.concat(acc["out"], F.array(acc["carry"])).alias("out"))

    def level(xs, carry, depth, finish):
        def some(acc, part):
            return level(part, acc["carry"], depth - 1, lambda done: F.struct(done["carry"].alias("carry"), F.concat(acc["out"], done["out"]).alias("out")))

        return F.aggregate(xs, F.struct(carry.alias("carry"), none.alias("out")), some if depth else one, finish)

    def all_of(held):
        parts = F.transform(_blocks(held, blocks[0]), lambda some: _blocks(some, blocks[1]))
        return F.zip_with(held, level(parts, zero, 2, lambda done: done["out"]), lambda x, carry: item(carry, x))

    return let(rows, all_of)


def find_all(text: Column, pattern: str, lead: tuple[int, ...] = (), value: tuple[int, ...] = (), key: int | None = None, guard: Column | None = None) -> Column:
    """Array of (start, end, value, key, at) of the leftmost non-overlapping matches.

    With value groups, a span is what they captured (one of them at most takes part in a match), and the lead groups hold what
    stands before it in the match; an empty capture gives an empty span. Without, it is the whole match. `key` names a group to report;
    `at` is where the match starts. Rows that fail the guard aren't scanned. A null text has no spans.
    """
    def captured(groups: tuple[int, ...], whole: Column) -> Column:
        """Per match, what the groups captured, joined."""
        if not groups:
            return F.transform(whole, lambda _: F.lit(""))
        out = F.regexp_extract_all(text, F.lit(pattern), F.lit(groups[0]))
        for g in groups[1:]:
            out = F.zip_with(out, F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), lambda a, b: F.concat(a, b))
        return out

    def moved(pos, x):
        return pos + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def span(pos, x):
        at = pos + F.length(x["gap"])
        start = at + F.length(x["before"])
        return F.when(x["hit"].isNotNull(), F.struct(start.alias("start"), (start + F.length(x["taken"])).alias("end"), x["taken"].alias("value"), x["key"].alias("key"), at.alias("at")))

    def placed(whole: Column) -> Column:
        taken = captured(value, whole) if value else whole
        rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), captured(lead, whole).alias("before"), taken.alias("taken"), captured((key,) if key is not None else (), whole).alias("key"))
        return F.filter(scan(rows, F.lit(0), moved, span), lambda s: s.isNotNull())

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    seen = text.isNotNull() & (text.rlike(pattern) if guard is None else guard)
    return F.when(seen, spans).otherwise(none_of(SPANS))

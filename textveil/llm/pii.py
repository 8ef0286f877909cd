"""Personal data: pattern matches, and identifiers that bootstrapped contexts discover. DataFrame functions only.

Base spans are leftmost non-overlapping matches of four patterns, with checks on what matched. Offsets come without Python:
the matches of a pattern and the pieces between them (split) alternate, so running lengths give the positions.

Contextual extraction. Seeds are the values of base spans. Other identifier-like strings (a token with a digit or an at sign, or
digit groups joined by single blanks, dots, hyphens, slashes or parentheses; LEAST characters or more, outside base spans)
are candidates. An occurrence's lexical patterns are the word before it, the two words before it, the word after it, and
the words on both sides. Patterns and values form a graph; scores go back and forth for ROUNDS rounds:
  pattern p, kind k: the sum of its values' confidences in k, over (number of its distinct values + DAMP),
                     if at least SUPPORT distinct seeds of k occur in it;
  value v, kind k:   1 for a seed of k, else 1 - product over its patterns of (1 - score).
Values are counted once per pattern, so copies of a text add nothing. Candidates in a pattern with score >= SURE, whose own
confidence is as high, become spans of that kind. Only spans and contexts, never texts, are shuffled.

Work is in proportion to a text's length and to its spans: texts are cut into blocks of BLOCK characters, so that reading at a place
doesn't start from the text's beginning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.spans import let, once, scan
from textveil.llm.common import fresh, lookup, named, small, table, written

KINDS = ("email", "ip", "card", "phone")
# Run starts are guarded so that each run of characters is tried once; possessive quantifiers don't backtrack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What stands for a base span where candidates are sought; they neither hold nor touch it.
HOLE = "\x01"
# Digit groups, each of which ends where no letter follows, or else a token.
CANDIDATE = (r"(?<![A-Za-z0-9._%+@:/\x01-])(?:\(?[0-9]++(?![A-Za-z_@%:])\)?(?:[\x20./-]{1,2}\(?[0-9]++(?![A-Za-z_@%:\x01])\)?)++"
             r"|[A-Za-z._%+:/-]*+[0-9@][A-Za-z0-9._%+@:/-]*+(?!\x01))")
BLOCK = 2048
LEAST = 6
CONTEXT = 48
ROUNDS = 3
SUPPORT = 5
DAMP = 2.0
SURE = 0.7
PLACE = "array<struct<start:int,kind:int,end:int>>"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octet(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _octet),
    "card": lambda m: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def matches(text: Column, pattern: str, kind: int, valid) -> Column:
    """Array of (start, kind, end, value) of the pattern's valid matches, in order; text isn't null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"))

    def moved(pos, x):
        return pos + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def span(pos, x):
        start = pos + F.length(x["gap"])
        return F.when(x["hit"].isNotNull() & valid(x["hit"]), F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("value")))

    return F.filter(scan(pairs, F.lit(0), moved, span), lambda s: s.isNotNull()).cast(SPAN)


def blocks_of(text: Column) -> Column:
    """A text in blocks of BLOCK characters, the last one shorter."""
    return F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text from start, which lies within it, to end (exclusive) or the text's own end."""
    lo, hi = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    first = F.get(blocks, lo)
    inside = F.substring(first, start - lo * BLOCK + 1, end - start)
    across = F.concat(F.substring(first, start - lo * BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, lo + 2, F.greatest(hi - lo - 1, F.lit(0))), ""),
                      F.coalesce(F.substring(F.get(blocks, hi), F.lit(1), end - hi * BLOCK), F.lit("")))
    return F.coalesce(F.when(lo == hi, inside).otherwise(across), F.lit(""))


def replaced(text: Column, spans: Column, by) -> Column:
    """The text with by(span, characters not yet covered) in place of each span; spans are sorted by start, and one that lies in those
    before it has none left. What sticks out of the spans before goes with them."""
    def part(blocks, pos, s):
        return F.when(s["end"] <= pos, "").otherwise(F.concat(cut(blocks, F.least(pos, s["start"]), s["start"]), by(s, pos)))

    def whole(blocks):
        parts = scan(spans, F.lit(0), lambda pos, s: F.greatest(pos, s["end"]), lambda pos, s: part(blocks, pos, s))
        last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(parts, ""), cut(blocks, last, F.length(text)))

    return F.when(F.size(spans) > 0, let(blocks_of(text), whole)).otherwise(text)


def _none() -> Column:
    return F.array().cast(SPAN)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind as listed in KINDS; a null text has none."""
    digit = text.rlike("[0-9]")
    guard = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": digit & text.contains("+")}
    each = [F.when(guard[k], matches(text, PATTERNS[k], i, VALID[k])).otherwise(_none()) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def row_key(id_: Column, text: Column) -> Column:
    """128 bits for each pair of id and text, nulls apart from empty ones."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("")) for x in (id_, text)]))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, base, seen): base spans, and those with the candidates in their contexts; key stands for id and text."""
    text = F.coalesce(named(text_col), F.lit(""))
    src = docs.select(row_key(named(id_col), named(text_col)).alias("key"), named(id_col).alias("doc_id"), text.alias("text"))
    src = src.withColumn("known", once(base_spans(F.col("text"))))
    seeking = F.col("text").rlike("[0-9@]")
    holes = replaced(F.col("text"), F.col("known"), lambda s, pos: F.repeat(F.lit(HOLE), s["end"] - F.greatest(s["start"], pos)))
    like = lambda m: (F.length(m) >= LEAST) & m.rlike("[0-9]|@[A-Za-z0-9]")
    src = src.withColumn("others", F.when(seeking, let(holes, lambda t: matches(t, CANDIDATE, len(KINDS), like))).otherwise(_none()))

    def seen(blocks):
        def context(s):
            before = F.lower(cut(blocks, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"]))
            after = F.lower(cut(blocks, s["end"], s["end"] + CONTEXT))
            words = F.regexp_extract_all(before, F.lit(r"\p{L}+"), F.lit(0))
            right = F.nullif(F.regexp_extract(after, r"^[^\p{L}]*(\p{L}+)", 1), F.lit(""))
            one, two = F.get(words, F.size(words) - 1), F.get(words, F.size(words) - 2)
            # null where a word is missing
            patterns = F.array(F.concat(one, F.lit(" _")), F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(F.lit("_ "), right), F.concat(one, F.lit(" _ "), right))
            return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lower(s["value"]).alias("value"), F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))

        return F.transform(F.concat("known", "others"), context)

    places = F.transform("known", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return src.select("key", "doc_id", places.alias("base"), F.when(F.size("known") + F.size("others") > 0, let(blocks_of(F.col("text")), seen)).alias("seen"))


def discover(spans: DataFrame) -> DataFrame:
    """(key, found): spans of candidates in high-confidence patterns, for the rows that have any."""
    occurrences = spans.select("key", F.explode("seen").alias("s")).select("key", "s.*")
    placed = occurrences.select("key", "start", "end", "kind", "value", F.explode("patterns").alias("pattern"))
    edges = written(placed.select("pattern", "value", F.when(F.col("kind") < len(KINDS), F.col("kind")).alias("seed")).distinct(), "pii-edges")
    seeds = edges.where("seed is not null")
    backed = seeds.groupBy("pattern", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= SUPPORT)
    backed = written(backed, "pii-backed")
    # distinct values of the backed patterns: a value may be a seed of two kinds, or a seed in one place and a candidate in another
    held = lookup(edges, written(backed.select("pattern").distinct(), "pii-kept"), ["pattern"]).select("pattern", "value").distinct()
    sizes = written(held.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")), "pii-sizes")
    backed = written(lookup(backed, sizes, ["pattern"]), "pii-patterns")
    # candidates that are in some backed pattern
    kinds = written(backed.groupBy("pattern").agg(F.array_sort(F.collect_list("kind")).alias("kinds")), "pii-kinds")  # at most one of each
    loose = lookup(edges.where("seed is null").select("pattern", "value"), kinds, ["pattern"]).select("pattern", "value", F.explode("kinds").alias("kind"))
    loose = written(loose, "pii-candidates")
    score = written(backed.select("pattern", "kind", (F.col("support") / (F.col("values") + DAMP)).alias("score")), "pii-scores")
    for _ in range(ROUNDS):
        # log1p(-1) would be minus infinity; scores stay below 1 because of DAMP
        value = lookup(loose, score, ["pattern", "kind"]).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("c"))
        value = written(value, "pii-values")
        gained = lookup(loose, value, ["value", "kind"]).groupBy("pattern", "kind").agg(F.sum("c").alias("gain"))
        score = written(backed.join(small(written(gained, "pii-gained")), ["pattern", "kind"], "left").select(
            "pattern", "kind", ((F.col("support") + F.coalesce("gain", F.lit(0.0))) / (F.col("values") + DAMP)).alias("score")), "pii-scores")
    sure = score.where(F.col("score") >= SURE)
    certain = lookup(lookup(loose, sure, ["pattern", "kind"]), value.where(F.col("c") >= SURE), ["value", "kind"])
    # of kinds that fit an occurrence, that of the highest confidence, then the first
    certain = certain.groupBy("pattern", "value").agg(F.min(F.struct((-F.col("c")).alias("c"), F.col("kind"))).alias("best"))
    hits = placed.where(F.col("kind") == len(KINDS)).drop("kind").join(small(written(certain, "pii-certain")), ["pattern", "value"])
    best = hits.groupBy("key", "start", "end").agg(F.min("best").alias("best")).select("key", "start", "end", "best.kind")
    return best.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("found"))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, base, found): arrays of (start, kind, end), kind an index into KINDS; one row per input row.

    Offsets count code points, end exclusive. A null or empty text has no spans. Equal rows get equal spans. An empty
    table gives no rows; other columns are ignored.
    """
    spans = written(with_spans(docs, id_col, text_col), "pii-spans")
    found = written(discover(spans), "pii-found")
    return lookup(spans.select("key", "doc_id", "base"), found, ["key"], "left").withColumn("found", F.coalesce("found", F.array().cast(PLACE)))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: DataFrame) -> DataFrame:
    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_found"),
                        (F.size("base") + F.size("found")).cast("long").alias("n_spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced by its kind in angle brackets, as in <email>.

    Of overlapping spans the one that starts first (then: first in KINDS) gives the kind; what sticks out of it goes with it.
    Null and empty texts stay as they are, equal rows get equal texts, other columns pass through, and an empty table gives no rows.
    """
    key_, spans_ = fresh(docs.columns, "span_key", "spans")
    spans = extract(docs, id_col, text_col).where((F.size("base") > 0) | (F.size("found") > 0))
    # equal rows have equal spans: a key's spans are those of any of them
    spans = written(spans.groupBy(F.col("key").alias(key_)).agg(F.first(F.array_sort(F.concat("base", "found"))).alias(spans_)), "pii-redacted")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    clean = replaced(named(text_col), F.col(spans_), lambda s, pos: F.when(s["start"] >= pos, F.element_at(names, s["kind"] + 1)).otherwise(""))
    joined = lookup(docs.withColumn(key_, row_key(named(id_col), named(text_col))), spans, [key_], "left")
    return joined.select(*[F.when(F.col(spans_).isNull(), named(c)).otherwise(clean).alias(c) if c == text_col else named(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return digest(extract(table(spark, sf_dir, "documents")))

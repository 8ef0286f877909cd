"""Mixing sources to target weights by systematic sampling.

A source's documents are taken in tiers of falling size: above the first of TIERS as a share of the target, above the
second, and so on. Every document of a tier expects the same number of copies e = what is left of the target / the size of
this tier and those after it, from 0 to MOST. Documents are ranked within their tier by (size, doc_id); with one
offset u in [0, 1) per source, the document of rank r is taken floor(r e + u) - floor((r - 1) e + u) times: once per integer
boundary that its interval of the prefix sum crosses. What a tier takes too much or too little, about one of its largest documents,
the smaller documents after it make up for, so that a source ends within about the least tier's share of its target,
as far as it has documents that small.

The rank is computed without bringing a source, or all documents of one size, into one task: documents are
dealt to about sqrt(n) buckets within each (source, size), ranked there, and the buckets' offsets come from
aggregated counts. Windows over sizes hold a row per distinct size of a tier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.functions.spans import once
from textveil.llm.common import fresh, lookup, named, small, table, written

#: A source is taken at most this often.
MOST = 3
#: Bounds between tiers, as shares of the target.
TIERS = (0.08, 0.01, 0.00125)
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size_sum) -> (source, source_size, weight, target), null-safe on source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. Targets share the total in proportion
    to weight; none exceeds `most` times its source's size, and the excess goes to the others by weight
    until none is above. In order of cap / weight the capped sources come first, so one pass of running sums finds
    them: a source is capped if its share of what the sources before it leave is above its cap.

    The windows here run over one row per source, in one task; sources are a small dimension.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.select("source", F.col("source_size"), ((F.row_number().over(order) - 1) % 3 + 1).cast("long").alias("weight"))
    every = Window.partitionBy()
    water = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    cum = ranked.withColumns({
        "total": F.sum("source_size").over(every),
        "weights": F.sum("weight").over(every),
        "caps_before": F.coalesce(F.sum(F.col("source_size") * most).over(water.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weights_before": F.coalesce(F.sum("weight").over(water.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    cum = cum.withColumn("capped", (F.col("total") - F.col("caps_before")) * F.col("weight") > F.col("source_size") * most * (F.col("weights") - F.col("weights_before")))
    rest = cum.withColumns({
        "left": F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size") * most)).over(every), F.lit(0)),
        "left_weights": F.col("weights") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(every), F.lit(0)),
    })
    target = F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise(
        F.col("left").cast("double") / F.col("left_weights") * F.col("weight"))
    return rest.select("source", "source_size", "weight", target.alias("target"))


def _hash31(text):
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def offset(source, seed: str = SEED):
    """One offset in [0, 1) per source, in steps of 2**-16, from an MD5 of seed and source."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("double") / 65536.0


def _copies(rank, e, u):
    """Integer boundaries up to a rank."""
    return F.floor(rank.cast("double") * e + u)


def mix(docs: DataFrame, most: int = MOST, seed: str = SEED, tiers: tuple[float, ...] = TIERS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row per input row.

    size counts the runs of characters other than space and U+0009 to U+000D; a null text has size 0 and is
    taken in its turn (its words taken are 0). Rows with equal doc_id are ranked apart; which of
    two equal rows gets which rank doesn't show. An empty table gives no rows. A source without any word
    has target 0, and its documents are not taken. Other columns are ignored.
    """
    sized = docs.select(named(id_col).alias("doc_id"), named(source_col).alias("source"),
                        F.coalesce(F.regexp_count(named(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # k stands for the source, null too, where rows are joined
    sized = written(sized.withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))), "mix-sizes")
    groups = written(sized.groupBy("k", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-groups")
    targets = source_targets(groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), most)
    targets = written(targets.withColumns({"k": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "u": offset(F.col("source"), seed)}).drop("source", "weight"), "mix-targets")
    tier = F.lit(len(tiers))
    for i, share in reversed(list(enumerate(tiers))):
        tier = F.when(F.col("size") > share * F.col("target"), i).otherwise(tier)
    before = Window.partitionBy("k", "tier").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    placed = lookup(groups, targets, ["k"]).withColumn("tier", tier.cast("int")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = written(placed, "mix-placed")
    # tier by tier: a row per source with what is left, and a row per source and tier with its expected copies
    left, expected = targets.select("k", "u", F.col("target").alias("rest"), F.col("source_size").alias("size_left")), None
    for i in range(len(tiers) + 1):
        e = F.when(F.col("size_left") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col("rest") / F.col("size_left")))).otherwise(F.lit(0.0))
        left = written(left.withColumn("e", e), "mix-tier")
        one = left.select("k", F.lit(i).alias("tier"), "e")
        expected = one if expected is None else expected.unionByName(one)
        if i < len(tiers):
            got = lookup(placed.where(F.col("tier") == i).drop("u"), left.select("k", "e", "u"), ["k"])
            got = got.groupBy("k").agg(F.sum(F.col("size") * (_copies(F.col("base") + F.col("n"), F.col("e"), F.col("u")) - _copies(F.col("base"), F.col("e"), F.col("u")))).alias("got"), F.sum(F.col("size") * F.col("n")).alias("gone"))
            left = left.join(small(written(got, "mix-got")), ["k"], "left").select("k", "u", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("rest"), (F.col("size_left") - F.coalesce("gone", F.lit(0))).alias("size_left"))
    per_size = lookup(placed, written(expected, "mix-expected"), ["k", "tier"]).select("k", "size", "base", "source_size", "target", "e", "u", F.ceil(F.sqrt("n")).alias("buckets"))
    per_size = written(per_size, "mix-sizes-placed")
    dealt = lookup(sized, per_size, ["k", "size"]).withColumn("bucket", _hash31(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % F.col("buckets"))
    counts = dealt.groupBy("k", "size", "bucket").agg(F.count(F.lit(1)).alias("n_bucket"))
    earlier = Window.partitionBy("k", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("n_bucket").over(earlier), F.lit(0))).drop("n_bucket")
    inner = Window.partitionBy("k", "size", "bucket").orderBy("doc_id")
    ranked = dealt.withColumn("r", F.row_number().over(inner)).join(counts, ["k", "size", "bucket"])
    rank = F.col("base") + F.col("offset") + F.col("r")
    copies = (_copies(rank, F.col("e"), F.col("u")) - _copies(rank - 1, F.col("e"), F.col("u"))).cast("long")
    return (ranked.withColumn("copies", F.least(copies, F.lit(most).cast("long")))
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """docs with each row as often as the mix takes it. Of rows with equal id, source and size, the copies go by order of text. Columns of
    any name pass through; an empty table gives no rows."""
    key, place, copies, copy = fresh(docs.columns, "mix_key", "mix_place", "mix_copies", "mix_copy")

    def of(id_, source, size):
        """A row's id, source and size as one key, nulls apart."""
        return F.to_json(F.struct(id_.cast("string").alias("i"), source.cast("string").alias("s"), size.alias("z")))

    plan = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    plan = written(plan.select(of(F.col("doc_id"), F.col("source"), F.col("size")).alias(key), F.col("copies").alias(copies)), "mix-plan")
    # once: else the join's test for nulls would count the words again
    rows = docs.withColumn(key, once(of(named(id_col), named(source_col), F.coalesce(F.regexp_count(named(text_col), F.lit(WORD)), F.lit(0)).cast("long"))))
    columns = [named(c) for c in docs.columns]
    repeat = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy)
    ties = written(plan.groupBy(key).count().where("count > 1").select(key), "mix-ties")
    if not ties.limit(1).count():
        return rows.join(small(plan.where(F.col(copies) > 0)), key).select(*columns, repeat).drop(copy)
    # rows that share a key are numbered on both sides
    single = rows.join(lookup(plan, ties, [key], "left_anti").where(F.col(copies) > 0), key).select(*columns, repeat).drop(copy)
    plan = lookup(plan, ties, [key]).withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(copies))))
    order = Window.partitionBy(key).orderBy(named(text_col).asc_nulls_last(), F.xxhash64(*columns))
    tied = lookup(rows, ties, [key]).withColumn(place, F.row_number().over(order)).join(plan.where(F.col(copies) > 0), [key, place])
    return single.unionByName(tied.select(*columns, repeat).drop(copy))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def _oracle() -> str:
    """SQL of the query: the tiers one after the other, each with its own subqueries."""
    tier = " ".join(f"WHEN size > {share!r} * target THEN {i}" for i, share in enumerate(TIERS))
    parts = ["l0 AS (SELECT source, target AS rest, source_size AS size_left FROM t)"]
    count = "CAST(floor(CAST({r} AS DOUBLE) * x.e + t.u) AS BIGINT)"
    for i in range(len(TIERS) + 1):
        parts.append(f"e{i} AS (SELECT source, {i} AS tier, rest, size_left, CASE WHEN size_left > 0 THEN greatest(0.0::DOUBLE, least({MOST}.0::DOUBLE, rest / size_left)) ELSE 0.0::DOUBLE END AS e FROM l{i})")
        parts.append(f"""l{i + 1} AS (SELECT e{i}.source, rest - coalesce(got, 0) AS rest, size_left - coalesce(gone, 0) AS size_left FROM e{i} LEFT JOIN (
    SELECT x.source, CAST(sum(size * ({count.format(r="base + n")} - {count.format(r="base")})) AS BIGINT) AS got, CAST(sum(size * n) AS BIGINT) AS gone
    FROM b JOIN e{i} x ON b.source IS NOT DISTINCT FROM x.source AND b.tier = x.tier JOIN t ON t.source IS NOT DISTINCT FROM b.source GROUP BY x.source) s ON e{i}.source IS NOT DISTINCT FROM s.source)""")
    every = " UNION ALL ".join(f"SELECT source, tier, e FROM e{i}" for i in range(len(TIERS) + 1))
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM g
), c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights,
    CAST(coalesce(sum(3 * source_size) OVER b, 0) AS BIGINT) AS caps_before, CAST(coalesce(sum(weight) OVER b, 0) AS BIGINT) AS weights_before
  FROM w WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), k AS (
  SELECT *, (total - caps_before) * weight > 3 * source_size * (weights - weights_before) AS capped FROM c
), l AS (
  SELECT *, total - CAST(coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0) AS BIGINT) AS rest,
    weights - CAST(coalesce(sum(CASE WHEN capped THEN weight END) OVER (), 0) AS BIGINT) AS rest_weights FROM k
), t0 AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(rest AS DOUBLE) / rest_weights * weight END AS target FROM l
), o AS (
  SELECT source, CAST(CAST('0x' || md5('{SEED}:' || coalesce('=' || source, 'null'))[1:4] AS BIGINT) AS DOUBLE) / 65536.0 AS u FROM g
), t AS (
  SELECT t0.*, u FROM t0 JOIN o ON t0.source IS NOT DISTINCT FROM o.source
), b AS (
  SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source, tier ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM (
    SELECT d.source, size, n, CASE {tier} ELSE {len(TIERS)} END AS tier FROM (SELECT source, size, count(*) AS n FROM d GROUP BY source, size) d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
), {", ".join(parts)}, x AS (
  {every}
), n AS (
  SELECT *, CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:7] AS BIGINT) % CAST(ceil(sqrt(count(*) OVER (PARTITION BY source, size))) AS BIGINT) AS bucket FROM d
), r AS (
  SELECT n.*, tier, row_number() OVER (PARTITION BY n.source, tier ORDER BY n.size, bucket, doc_id) AS r FROM n JOIN b ON n.source IS NOT DISTINCT FROM b.source AND n.size = b.size
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (
  SELECT r.doc_id, r.size, t.source_size, t.target, least({count.format(r="r.r")} - {count.format(r="r.r - 1")}, {MOST}) AS copies
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source JOIN x ON x.source IS NOT DISTINCT FROM r.source AND x.tier = r.tier)
"""


ORACLE = _oracle()

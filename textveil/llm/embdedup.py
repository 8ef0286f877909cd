"""Near-duplicate vectors: int8 tile products with rigorous error bounds, full precision where they leave doubt.

Only rows with equal, non-null labels are compared. Equal vectors collapse to one representative with a
count first. Each label's representatives are dealt to blocks of about BLOCK rows, and one task compares
two blocks at a time; a tile returns a row per vector with links (how many vectors, and the smallest one of
its group inside the tile), never its pairs. Work within one label is quadratic, as comparing all its
rows is; a tile's memory is bounded by two blocks.

Bounds: with x = s q + r for each unit vector x (s the scale, q int8 in -127..127, r the rest),
<x, y> = s s' <q, q'> + <r, s' q'> + <x, r'>, so |<x, y> - s s' <q, q'>| <= |r| |s' q'| + |r'| (|x| = 1).
The norms are computed per vector. Products of int8 vectors are integers below 2^24 for up to 1040 dimensions and
so exact in float32, which BLAS multiplies fast; more dimensions are summed in float64.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import by_sorted_keys, components, lookup, named, small, table, written

THRESHOLD = 0.98
BLOCK = 4096
STRIP = 512  # rows of a block that are multiplied together


def usable(vec: str, dtype: str = "double"):
    """Not null or empty, without null or non-finite components, and not all zero."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0)


def quantise(x):
    """Unit rows x (float64) -> (int8 codes, scales, norms of s q, norms of the rest)."""
    import numpy as np

    s = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / s[:, None]).astype(np.int8)
    back = q * s[:, None]
    return q, s, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def links_in_tile(a, b, threshold: float, same: bool):
    """(i, j) of rows of a and b whose cosine in float64 is >= threshold; same: a is b, and i < j."""
    import numpy as np

    def unit(v):
        # a scale by the largest component keeps the squares of tiny or huge components in range
        v = v / np.abs(v).max(axis=1)[:, None]
        return v / np.sqrt((v * v).sum(axis=1))[:, None]

    xa, xb = unit(a), unit(b)
    (qa, sa, na, ra), (qb, sb, nb, rb) = quantise(xa), quantise(xb)
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    pa_, pb, found = qa.astype(kind), qb.astype(kind), []
    for at in range(0, len(a), STRIP):
        rows, first = slice(at, at + STRIP), at if same else 0  # of a block with itself, the half above the diagonal
        dots = (pa_[rows] @ pb[first:].T).astype(np.float64)
        dots *= sa[rows, None]
        dots *= sb[None, first:]
        dots += ra[rows, None] * nb[None, first:]
        dots += rb[None, first:]
        p, q = np.nonzero(dots >= threshold - 1e-9)
        p, q = p + at, q + first
        keep = p < q if same else slice(None)
        found.append((p[keep], q[keep]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    hit = np.zeros(len(i), bool)
    for at in range(0, len(i), 65536):
        p, q = i[at : at + 65536], j[at : at + 65536]
        u, v = a[p], b[q]
        cos = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
        if not np.isfinite(cos).all():
            cos = (xa[p] * xb[q]).sum(axis=1)
        hit[at : at + 65536] = cos >= threshold
    return i[hit], j[hit]


def forest(n: int, i, j):
    """For nodes 0..n-1 and edges (i, j): the smallest node of each one's component."""
    import numpy as np

    root = np.arange(n)
    while True:
        lo, before = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(root, root[i], lo)
        np.minimum.at(root, root[j], lo)
        root = root[root]
        if (root == before).all():
            return root


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
    nothing. Vectors of different length don't link. Rows that repeat a vec_id are separate vectors for
    n_links and share a component. An empty table gives no rows; a threshold above 1 isn't useful.
    Other columns are ignored.
    """
    base = rows.select(named(id_col).cast("long").alias("vec_id"), named(label_col).cast("string").alias("label"), named(vec_col).cast("array<double>").alias("v"))
    base = base.withColumn("v", F.when(usable("v") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.transform("v", lambda x: x + F.lit(0.0))))
    # two hashes, 128 bits, stand for label and vector where equal ones meet
    base = base.withColumns({"h": F.xxhash64("label", "v"), "g": F.xxhash64(F.lit("g"), "v", "label")})
    ok = base.where("v is not null")
    reps = written(ok.groupBy("h", "g").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vec-reps")
    # rows of different length are never compared
    dim = F.size("v").alias("dim")
    blocks = reps.groupBy("label", dim).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = reps.withColumn("dim", F.size("v")).join(small(blocks), ["label", "dim"]).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tiles = dealt.select("label", "dim", "b", "rep", "h", "n", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    tiles = tiles.select("label", "dim", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "rep", "h", "n", "v")
    keys = ["label", "dim", "lo", "hi"]

    @by_sorted_keys(keys)
    def compare(key, t):
        import numpy as np
        import pyarrow as pa

        lo, hi = key[2], key[3]
        v = t.column("v").combine_chunks()
        x = v.flatten().to_numpy().reshape(len(v), -1)
        b, rep, h, n = (t.column(c).to_numpy() for c in ("b", "rep", "h", "n"))
        order = np.argsort(rep, kind="stable")
        x, b, rep, h, n = x[order], b[order], rep[order], h[order], n[order]
        if lo == hi:
            i, j = links_in_tile(x, x, threshold, True)
        else:
            left, right = np.flatnonzero(b == lo), np.flatnonzero(b == hi)
            if not len(left) or not len(right):
                return
            i, j = links_in_tile(x[left], x[right], threshold, False)
            i, j = left[i], right[j]
        if not len(i):
            return
        links = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
        root = forest(len(rep), i, j)
        got = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_pydict({"rep": pa.array(rep[got], pa.int64()), "h": pa.array(h[got], pa.int64()), "links": pa.array(links[got].astype(np.int64)), "root": pa.array(rep[root[got]], pa.int64())})

    found = written(tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "rep long, h long, links long, root long"), "vec-links")
    counts = found.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    root = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vec")
    of_rep = reps.select("h", "g", "rep", "n").join(small(counts), ["rep", "h"], "left").join(small(root.withColumnRenamed("id", "rep")), "rep", "left")
    of_rep = of_rep.select("h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    # only classes that have links need the join; the rest keep their own id
    of_rep = written(of_rep.where("n_links > 0"), "vec-linked")
    joined = lookup(ok.select("vec_id", "h", "g"), of_rep, ["h", "g"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = base.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
)
SELECT v.vec_id, CAST((SELECT count(*) FROM pairs p WHERE p.a = v.vec_id) AS BIGINT) AS n_links,
  least(v.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) AS kept
FROM v
"""

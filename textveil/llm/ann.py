"""Approximate nearest neighbours by an inverted multi-index, nearness being the inner product.

Each vector is cut into two halves, and each half is quantised to one of K centroids of its own codebook, so that
a vector lies in one of K * K cells. For a query, a heap walks centroid pairs (a, b) by falling sum of the query
halves' products with the centroids until the cells seen hold a share of the index that was calibrated for
the target recall. All vectors in those cells are reranked by the true product in float64.

The codebooks and the share are fitted on a bounded sample (SAMPLE vectors); every vector is indexed. K grows with the root of
the number of vectors, from LEAST_K to MOST_K, so that a cell holds some PER_CELL of them. Vectors are
dealt to shards of neighbouring first centroids, large ones split by a hash of the id, so no shard is larger
than about SHARD vectors however many fall in one cell; a query goes only to shards with cells it visits,
and a task streams its queries past one shard. For each query the sample's vectors in visited cells give a floor
under the k-th best score; a shard returns only candidates above it, k at most.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.llm.common import bounded_sample, named, table, task, written
from textveil.llm.embdedup import usable

LEAST_K, MOST_K = 16, 512  # centroids for each half: multiples of 16
PER_CELL = 12
SAMPLE = 8192
SHARD = 8192
LEAST_SHARD = 512
NEIGHBOURS = 20
RECALL = 0.97


def kmeans(x, k: int, rounds: int = 12, seed: int = 7):
    """Centroids of x; deterministic."""
    import numpy as np

    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    c = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            c[:, d] = np.where(n > 0, np.bincount(at, x[:, d], k) / np.maximum(n, 1), c[:, d])
    return c


def nearest(x, c):
    """Index of the nearest centroid of each row."""
    return ((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)


def walk(p, q, counts, want: int):
    """Cells visited, as bits over b in words of 64 for each a: pairs by falling p[a] + q[b] until they hold `want` vectors."""
    import numpy as np

    oa, ob = np.argsort(-p, kind="stable"), np.argsort(-q, kind="stable")
    sp, sq = p[oa].tolist(), q[ob].tolist()
    wide, high = ob.tolist(), oa.tolist()
    n = counts.tolist() if isinstance(counts, np.ndarray) else counts
    masks, heap, got = [0] * len(n), [(-(sp[0] + sq[0]), 0, 0)], 0
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        masks[high[i]] |= 1 << wide[j]
        got += n[high[i]][wide[j]]
        if j + 1 < len(wide):
            heapq.heappush(heap, (-(sp[i] + sq[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(high):
            heapq.heappush(heap, (-(sp[i + 1] + sq[0]), i + 1, 0))
    words = -(-len(wide) // 64)
    return np.frombuffer(b"".join(m.to_bytes(8 * words, "little") for m in masks), "<u8").reshape(len(n), words)


def visited(masks, a, b):
    """Whether each pair (a, b) of arrays is among the cells of masks (any leading axes, a, words)."""
    import numpy as np

    return (masks[..., a, b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) > 0


def calibrated_share(x, a, b, c1, c2, k: int, recall: float, queries: int = 256) -> float:
    """The share of vectors whose cells, in order of a query's sums, hold `recall` of its true k nearest in the sample."""
    import numpy as np

    h, shares = c1.shape[1], []
    # as deep in the sample as k is in it: with more vectors the nearest stand out more
    for i in range(min(queries, len(x))):
        q = x[i]
        cell = (c1 @ q[:h])[a] + (c2 @ q[h:])[b]
        true = x @ q
        true[i] = -np.inf
        top = np.argsort(-true, kind="stable")[: min(k, len(x) - 1)]
        shares.append((cell[None, :] >= cell[top][:, None]).mean(axis=1))
    return float(np.quantile(np.concatenate(shares), recall)) if shares and len(x) > 1 else 1.0


def best(scores, ids, k: int):
    """Order of the k best by falling score, then id."""
    import numpy as np

    return np.lexsort((ids, -scores))[:k]


def neighbours(rows: DataFrame, is_query, k: int = NEIGHBOURS, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row where the column is_query holds.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
    another length than most. Candidates are all rows whose id isn't the query's; ties go to the smaller id. Fewer
    than k candidates are all returned. A query id that repeats is one query with its smallest vector (by
    components); repeated candidate rows each count. No usable row gives no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    vecs = rows.select(named(id_col).cast("long").alias("id"), named(vec_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
    vecs = vecs.where(F.col("id").isNotNull() & F.coalesce(usable("v"), F.lit(False)))
    dims = vecs.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    dim, total = dims[0]["d"], dims[0]["count"]
    vecs = vecs.where(F.size("v") == dim)

    import numpy as np

    got = bounded_sample(vecs.select("id", "v"), "id", SAMPLE, total).collect()
    x, x_id = np.array([r["v"] for r in got]), np.array([r["id"] for r in got], np.int64)
    half = max(1, dim // 2)
    size = min(MOST_K, max(LEAST_K, 16 * round((total / PER_CELL) ** 0.5 / 16)))
    c1, c2 = kmeans(x[:, :half], size), kmeans(x[:, half:], size) if dim > 1 else np.zeros((1, 0))
    xa, xb = nearest(x[:, :half], c1), nearest(x[:, half:], c2)
    share = calibrated_share(x, xa, xb, c1, c2, k, recall)

    @task
    def assign(batches):
        import pyarrow as pa

        for t in batches:
            if t.num_rows:
                v = t.column("v").flatten().to_numpy().reshape(t.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(nearest(v[:, :half], c1).astype(np.int32)), pa.array(nearest(v[:, half:], c2).astype(np.int32))], names=[*t.schema.names, "a", "b"])

    index = written(vecs.mapInArrow(assign, "id long, v array<double>, is_query boolean, a int, b int"), "ann-index")
    counts = np.zeros((len(c1), len(c2)), np.int64)
    for r in index.groupBy("a", "b").count().collect():  # MOST_K * MOST_K rows at most
        counts[r["a"], r["b"]] = r["count"]
    want = max(int(np.ceil(share * total)), k + 1)

    # shards: runs of first centroids, from LEAST_SHARD vectors on; those above SHARD are split by a hash
    runs, lo, held = [], 0, 0
    for a, n in enumerate(counts.sum(axis=1)):
        held += int(n)
        if held >= LEAST_SHARD or a == len(counts) - 1:
            runs.append((lo, a + 1, max(1, -(-held // SHARD))))
            lo, held = a + 1, 0
    first = np.cumsum([0, *(r[2] for r in runs)]).tolist()
    of_a = [i for i, r in enumerate(runs) for _ in range(r[0], r[1])]
    base = F.element_at(F.array(*[F.lit(first[i]) for i in of_a]), F.col("a") + 1)
    parts = F.element_at(F.array(*[F.lit(runs[i][2]) for i in of_a]), F.col("a") + 1)
    entries = index.select((base + F.pmod(F.xxhash64("id"), parts)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "v", "a", "b",
                           F.lit(None).cast("array<long>").alias("masks"), F.lit(None).cast("double").alias("floor"))

    @task
    def visit(batches):
        import pyarrow as pa

        grid = counts.tolist()
        for t in batches:
            out = {"shard": [], "id": [], "v": [], "masks": [], "floor": []}
            for i, q in zip(t.column("id").to_pylist(), t.column("v").to_pylist(), strict=True):
                v = np.array(q)
                m = walk(c1 @ v[:half], c2 @ v[half:], grid, want)
                s = (x[visited(m, xa, xb) & (x_id != i)] * v).sum(axis=1)
                floor = float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else None
                signed, any_ = m.view(np.int64), m.any(axis=1)
                for r, (lo, hi, n) in enumerate(runs):
                    if any_[lo:hi].any():
                        row = signed[lo:hi].ravel().tolist()
                        for p in range(n):
                            out["shard"].append(first[r] + p)
                            out["id"].append(i)
                            out["v"].append(q)
                            out["masks"].append(row)
                            out["floor"].append(floor)
                if len(out["id"]) >= 2000:
                    yield rows_of(pa, out)
                    out = {c: [] for c in out}
            yield rows_of(pa, out)

    def rows_of(pa, out):
        n = len(out["id"])
        return pa.RecordBatch.from_arrays(
            [pa.array(out["shard"], pa.int32()), pa.array([1] * n, pa.int32()), pa.array(out["id"], pa.int64()), pa.array(out["v"], pa.list_(pa.float64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(out["masks"], pa.list_(pa.int64())), pa.array(out["floor"], pa.float64())],
            names=["shard", "kind", "id", "v", "a", "b", "masks", "floor"])

    # the walk is the work here, and the groups after the exchange are few and small, which Spark would merge into few tasks
    asked = index.where("is_query").groupBy("id").agg(F.min("v").alias("v")).repartition(max(8, spark.sparkContext.defaultParallelism, len(counts) // 8), "id")
    asked = asked.mapInArrow(visit, "shard int, kind int, id long, v array<double>, a int, b int, masks array<long>, floor double")

    @task
    def rerank(batches):
        import pyarrow as pa

        at, held = None, []
        ids = v = a = b = None
        for t in batches:
            if not t.num_rows:
                continue
            shard, kind = t.column("shard").to_numpy(), t.column("kind").to_numpy()
            cut = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), t.num_rows]
            for lo, hi in zip(cut, cut[1:], strict=False):
                part = t.slice(lo, hi - lo)
                if shard[lo] != at:
                    at, held, ids = shard[lo], [], None
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if ids is None:
                    entries = pa.Table.from_batches(held)
                    ids = entries.column("id").to_numpy()
                    v = entries.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
                    a, b = entries.column("a").to_numpy(), entries.column("b").to_numpy()
                    run = next(r for r, f in zip(runs, first, strict=False) if f <= at < f + r[2])
                    a = a - run[0]
                for s in range(0, part.num_rows, 256):
                    some = part.slice(s, 256)
                    q = some.column("v").flatten().to_numpy().reshape(some.num_rows, -1)
                    masks = some.column("masks").flatten().to_numpy().view(np.uint64).reshape(some.num_rows, run[1] - run[0], -1)
                    rough = q @ v.T
                    rough[~visited(masks, a, b)] = -np.inf
                    out = []
                    slack = 1e-9 * (1 + np.abs(q).sum(axis=1) * np.abs(v).max())
                    for i, (own, floor) in enumerate(zip(some.column("id").to_pylist(), some.column("floor").to_pylist(), strict=True)):
                        r = rough[i]
                        r[ids == own] = -np.inf
                        low = -np.inf if floor is None else floor
                        if len(r) > k:
                            low = max(low, np.partition(r, len(r) - k)[len(r) - k])
                        pick = np.flatnonzero((r >= low - slack[i]) & (r > -np.inf))
                        if len(pick):
                            exact = (v[pick] * q[i]).sum(axis=1)
                            o = best(exact, ids[pick], k)
                            out.append((np.full(len(o), own), ids[pick][o], exact[o]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    both = entries.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(rerank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

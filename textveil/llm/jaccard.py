"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

A text's n-grams are runs of five words: words are runs of characters other than space and U+0009 to U+000D, in lower case; a
text of one to four words has one n-gram, all its words. Texts whose sets are equal form a class; classes are joined.

Bands: rows per band and bands are chosen so that a pair at the threshold meets in some band with the target recall.
Classes are shuffled on band hashes. A bucket's classes are dealt to blocks, and a task gets two blocks of one bucket, so that
neither a large bucket nor its pairs land in one task. A pair is the business of the first band in which it meets.
Two passes keep the shuffles small: the first ships only band hashes and names the classes that have such a pair in a
bucket; the second ships the n-gram sets of those, to the buckets where they are needed, and counts exact
intersections by products of 0/1 matrices. Tiles return rows per class (links, smallest member of its group), never pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.llm.common import by_sorted_keys, components, fresh, lookup, named, small, table, task, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 100
BLOCK = 256
CHUNK = 1 << 19


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows per band whose bands for the target recall take at most so many hashes."""
    best = None
    for rows in range(1, 32):
        p = threshold**rows
        bands = 1 if p >= recall else math.ceil(math.log1p(-recall) / math.log1p(-p))
        if bands * rows <= most or best is None:
            best = (bands, rows)
    return best


def mix64(x):
    """Finaliser of splitmix64, on uint64 arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed n-grams of texts laid end to end in one byte array."""

    P, Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93

    def __init__(self, words: int = WORDS):
        import numpy as np

        self.words = words
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int):
        import numpy as np

        if len(self.power) < n:
            for name, p in (("power", self.P), ("inverse", pow(self.P, -1, 1 << 64))):
                steps = np.full(n, p, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sets(self, data, lengths):
        """(hashes, counts): for texts of so many bytes laid end to end, each one's sorted distinct n-gram hashes."""
        import numpy as np

        with np.errstate(over="ignore"):
            n = len(data)
            self.grow(n + 1)
            ends = np.cumsum(lengths)
            gap = self.space[data]
            first = np.ones(n, bool)
            first[1:] = gap[:-1]
            edge = ends[:-1]
            first[edge[edge < n]] = True
            first &= ~gap
            start = np.flatnonzero(first)
            last = np.ones(n, bool)
            last[:-1] = gap[1:]
            last[edge[(edge > 0) & (edge <= n)] - 1] = True
            last &= ~gap
            stop = np.flatnonzero(last) + 1
            run = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=run[1:])
            word = mix64((run[stop] - run[start]) * self.inverse[start] + (stop - start).astype(np.uint64) * np.uint64(self.Q))
            owner = np.searchsorted(ends, start, side="right")
            per = np.bincount(owner, minlength=len(lengths))
            # n-grams by their first word; a text with fewer words has one, padded by zeros
            k = self.words
            padded = np.concatenate([word, np.zeros(k, np.uint64)])
            at = np.arange(len(word)) - np.repeat(np.cumsum(per) - per, per)
            left = np.repeat(per, per) - at
            gram = np.zeros(len(word), np.uint64)
            for i in range(k):
                gram = gram * np.uint64(self.Q) + np.where(left > i, padded[i : i + len(word)], np.uint64(0))
            use = (left >= k) | (at == 0)
            gram, owner = mix64(gram[use]), owner[use]
            sizes = np.bincount(owner, minlength=len(lengths))
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            out = [np.unique(gram[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return out

    def batches(self, column, size: int = CHUNK):
        """(first row, list of sets) for runs of rows of an Arrow string column with about `size` bytes each."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for lo in range(0, len(column), 2000):
            part = column.slice(lo, 2000)
            text = pc.utf8_lower(pc.fill_null(part.cast(pa.large_string()), "")).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            group = (offsets[1:] - offsets[0]) // size
            cut = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(text)]
            for a, b in zip(cut, cut[1:], strict=False):
                if b > a:
                    yield lo + a, self.sets(data[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]))


def signatures(sets, bands: int, rows: int, seed: int = 11):
    """Band hashes (texts, bands) as int64 of non-empty sets."""
    import numpy as np

    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.zeros((len(sets), bands), np.uint64)
    with np.errstate(over="ignore"):
        # blocks of whole sets that stay in the cache
        cut = [0, *(np.flatnonzero(np.diff(starts // 32768)) + 1).tolist(), len(sets)]
        for a, b in zip(cut, cut[1:], strict=False):
            h = flat[starts[a] : starts[b] if b < len(sets) else len(flat)]
            at = starts[a:b] - starts[a]
            for i in range(bands * rows):
                x = h ^ xor[i]
                x *= mul[i]
                least = np.minimum.reduceat(x, at)
                out[a:b, i // rows] = mix64(out[a:b, i // rows] * np.uint64(Shingler.Q) + least)
    return out.view(np.int64)


def first_meetings(bands, sizes, band: int, threshold: float, left, right, same: bool):
    """Pairs (i in left, j in right) that meet first in this band and whose sizes allow the threshold."""
    import numpy as np

    x, y = bands[left], bands[right]
    ok = np.ones((len(left), len(right)), bool)
    for k in range(band):
        ok &= x[:, k][:, None] != y[:, k][None, :]
    p, q = sizes[left][:, None], sizes[right][None, :]
    ok &= np.minimum(p, q) >= threshold * np.maximum(p, q) - 1e-9
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    return (i[i < j], j[i < j]) if same else (i, j)


def intersections(values, sizes, i, j, chunk: int = 4096):
    """Sizes of the intersections of pairs (i, j) of sets, given as one flat array: sums of products of 0/1 matrices."""
    import numpy as np

    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1  # the others are in no intersection
    number = np.cumsum(shared) - 1
    keep = shared[code]
    code, owner = number[code[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    rows, cols = np.unique(i), np.unique(j)
    at_i, at_j = np.searchsorted(rows, i), np.searchsorted(cols, j)
    total, n = np.zeros((len(rows), len(cols)), np.float32), int(shared.sum())
    cuts = np.searchsorted(code, np.arange(0, n + chunk, chunk))
    for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = np.zeros((len(sizes), min(chunk, n - c * chunk)), np.float32)
        m[owner[a:b], code[a:b] - c * chunk] = 1
        total += m[rows] @ m[cols].T
    return total[at_i, at_j].astype(np.int64)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, block: int = BLOCK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, copy_id, n_links): one row per input row.

    copy_id is the smallest id with the same n-gram set, class_id the smallest id reachable by links, n_links the number of
    other rows with a similarity of at least the threshold. Texts that are null or without a word, and rows without id,
    link with nothing. Rows that repeat an id are separate for n_links; their classes are joined. An empty table
    gives no rows; other columns are ignored.
    """
    from textveil.llm.embdedup import forest

    bands, rows = banding(threshold, recall)
    src = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))

    @task
    def sign(batches):
        import numpy as np
        import pyarrow as pa

        shingler = Shingler(words)
        for batch in batches:
            for lo, sets in shingler.batches(batch.column("text")):
                full = [s for s in sets if len(s)]
                has = np.array([len(s) > 0 for s in sets])
                with np.errstate(over="ignore"):
                    fp = np.array([[int(s.sum(dtype=np.uint64)), int(mix64(s).sum(dtype=np.uint64))] for s in sets], np.uint64).view(np.int64)
                sig = np.zeros((len(sets), bands), np.int64)
                if full:
                    sig[has] = signatures(full, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.ListArray.from_arrays(np.arange(0, sig.size + 1, bands, dtype=np.int32), sig.ravel())],
                    names=["doc_id", "size", "f", "g", "bands"])

    signed = written(src.mapInArrow(sign, "doc_id long, size int, f long, g long, bands array<long>"), "jaccard-signed")
    part = signed.where("size > 0 and doc_id is not null")
    classes = written(part.groupBy("f", "g", "size").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "jaccard-classes")

    in_bands = classes.select(F.posexplode("bands").alias("band", "h"), "rep", "f")
    buckets = in_bands.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "h", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = lookup(in_bands, written(buckets, "jaccard-buckets"), ["band", "h"]).withColumn("b", F.pmod(F.xxhash64("rep", "f"), F.col("blocks")).cast("int"))
    members = members.join(classes.select("rep", "f", "size", "copies", "bands"), ["rep", "f"])
    tiles = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("band", "h", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "rep", "f", "size", "copies", "bands")
    keys = ["band", "h", "lo", "hi"]

    def pairs_of(key, t):
        """Columns as arrays, and the tile's own pairs."""
        import numpy as np

        band, _, lo, hi = key
        col = {c: t.column(c).to_numpy() for c in ("b", "rep", "f", "size", "copies")}
        sig = t.column("bands").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        left = np.flatnonzero(col["b"] == lo)
        right = left if lo == hi else np.flatnonzero(col["b"] == hi)
        i, j = first_meetings(sig, col["size"].astype(float), int(band), threshold, left, right, lo == hi)
        return col, i, j

    @by_sorted_keys(keys)
    def name_needed(key, t):
        import numpy as np
        import pyarrow as pa

        if t.num_rows < 2:
            return
        _, i, j = pairs_of(key, t)
        if len(i):
            t = t.combine_chunks()
            yield from t.take(pa.array(np.union1d(i, j))).to_batches()

    schema = "band int, h long, lo int, hi int, b int, rep long, f long, size int, copies long, bands array<long>"
    needed = written(tiles.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(name_needed, schema), "jaccard-needed")

    @task
    def shingle(batches):
        import numpy as np
        import pyarrow as pa

        shingler = Shingler(words)
        for batch in batches:
            for lo, sets in shingler.batches(batch.column("text")):
                with np.errstate(over="ignore"):
                    f = np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                flat = np.concatenate(sets).view(np.int64)
                offsets = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(sets)), pa.array(f), pa.ListArray.from_arrays(offsets, flat)], names=["rep", "f", "grams"])

    wanted = needed.select(F.col("rep").alias("doc_id")).distinct()
    sets = src.join(small(wanted), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(shingle, "rep long, f long, grams array<long>")

    @by_sorted_keys(keys)
    def verify(key, t):
        import numpy as np
        import pyarrow as pa

        t = t.combine_chunks()
        if t.num_rows < 2:
            return
        # a row per class, in order of id: equal input rows give a class's set more than once
        order = np.lexsort((t.column("f").to_numpy(), t.column("rep").to_numpy()))
        rep, f = t.column("rep").to_numpy()[order], t.column("f").to_numpy()[order]
        new = np.ones(len(order), bool)
        new[1:] = (rep[1:] != rep[:-1]) | (f[1:] != f[:-1])
        t = t.take(pa.array(order[new])).combine_chunks()
        col, i, j = pairs_of(key, t)
        if not len(i):
            return
        grams = t.column("grams").combine_chunks()
        common = intersections(grams.flatten().to_numpy(), np.diff(grams.offsets.to_numpy()), i, j)
        either = col["size"][i].astype(np.int64) + col["size"][j] - common
        ok = common >= threshold * either - 1e-9
        i, j = i[ok], j[ok]
        if not len(i):
            return
        n = t.num_rows
        links = np.bincount(i, col["copies"][j], n) + np.bincount(j, col["copies"][i], n)
        root = forest(n, i, j)
        got = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_pydict({"rep": pa.array(col["rep"][got], pa.int64()), "f": pa.array(col["f"][got], pa.int64()), "links": pa.array(links[got].astype(np.int64)), "root": pa.array(col["rep"][root[got]], pa.int64())})

    shipped = needed.join(sets, ["rep", "f"]).select(*keys, "b", "rep", "f", "size", "copies", "bands", "grams")
    found = written(shipped.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(verify, "rep long, f long, links long, root long"), "jaccard-links")

    counts = written(found.groupBy("rep", "f").agg(F.sum("links").alias("links")), "jaccard-counts")
    root = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "jaccard")
    linked = classes.drop("bands").join(small(counts), ["rep", "f"], "left").join(small(root.withColumnRenamed("id", "rep")), "rep", "left")
    linked = linked.where("copies > 1 or links is not null or root is not null").select(
        "f", "g", "size", F.col("rep").alias("copy_id"), F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = lookup(part.select("doc_id", "f", "g", "size"), written(linked, "jaccard-linked"), ["f", "g", "size"], "left")
    rest = signed.where("not (size > 0 and doc_id is not null)").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")).unionByName(rest)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: the one whose id is the class's. Rows without id stay; of rows that share an id, the
    one with the smallest text stays if that id does. Columns of any name pass through; an empty table gives no rows."""
    key, row = fresh(docs.columns, "jaccard_id", "jaccard_row")
    found = written(near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("doc_id is not null"), "jaccard-decided")
    gone = written(found.where("class_id <> doc_id").select(F.col("doc_id").alias(key)).distinct(), "jaccard-gone")
    out = lookup(docs.withColumn(key, named(id_col).cast("long")), gone, [key], "left_anti")
    twice = written(found.where("class_id = doc_id").groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key), "jaccard-twice")
    if twice.limit(1).count():
        # a row per id: the rank is cut to the first before the exchange, so many rows of one id don't meet in a task
        first = Window.partitionBy(key).orderBy(named(text_col).asc_nulls_last(), F.xxhash64(*[named(c) for c in docs.columns]))
        again = lookup(out, twice, [key], "left_semi").withColumn(row, F.row_number().over(first)).where(F.col(row) == 1).drop(row)
        out = lookup(out, twice, [key], "left_anti").unionByName(again)
    return out.select(*[named(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

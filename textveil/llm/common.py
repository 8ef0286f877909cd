"""What several corpus operators share: written intermediate tables, folds, checked broadcasts, components."""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textveil.sources.io import spread

#: A side may be broadcast if it has at most so many rows and its values take at most so many bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: At most so many keys count as hot in a lookup; with fewer rows than HOT_ROWS none does.
HOT_KEYS = 20_000
HOT_ROWS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors and driver share: spark.checkpoint.dir. Only a local master may do without, and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "textveil-checkpoints")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh(columns, *names: str) -> list[str]:
    """The names, lengthened until none is among columns (which are compared without case, as Spark does)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def named(column: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_written() -> None:
    """Delete the intermediate tables written so far, as is done when the driver ends. Results that are still to be read depend on
    them, so a long session calls this between jobs, when it has stored what it wants to keep."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session has ended before
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and any executor can go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textveil/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string")) % parts


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes; at most one row more is looked at."""
    fixed, free = 0, []
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("string", "binary"):
            free.append(F.octet_length(named(f.name)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            free.append(F.octet_length(F.to_json(F.struct(named(f.name)))))
        else:
            fixed += 8
    width = sum((F.coalesce(x, F.lit(0)).cast("long") for x in free), F.lit(fixed).cast("long"))
    got = df.limit(rows + 1).select(width.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).first()
    return got["n"] <= rows and (got["w"] or 0) <= size


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it fits; else Spark joins it by shuffles, splitting hot keys."""
    return F.broadcast(df) if fits(df, rows) else df


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join (inner or left) of left, whose keys may be as uneven as they like, with right, which has each key once; both written tables.

    A right side that fits is broadcast. Else the rows of hot keys (at most HOT_KEYS of them, by how hot is defined) meet a
    broadcast of those keys' rows and aren't shuffled at all, and the others are joined by a shuffle.
    """
    if fits(right):
        return left.join(F.broadcast(right), keys, how)
    most = max(HOT_ROWS, left.count() // HOT_KEYS)
    hot = written(left.groupBy(*keys).count().where(F.col("count") > most).select(*keys), "hot-keys")
    if not hot.limit(1).count():
        return left.join(right, keys, how)
    few = right.join(F.broadcast(hot), keys, "left_semi")
    many = left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few), keys, how)
    return many.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; those with texts are dealt out to all cores if they come in fewer splits."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def bounded_sample(df: DataFrame, key: str, rows: int, total: int | None = None) -> DataFrame:
    """At most `rows` rows, those with the smallest hash of key: a hash threshold, then an exact limit."""
    total = df.count() if total is None else total
    h = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30))
    if total > rows:
        df = df.where(h < int((1 << 30) * min(1.0, 1.2 * rows / total + 64 / total)))
    return df.orderBy(h, key).limit(rows)


def components(edges: DataFrame, prefix: str) -> DataFrame:
    """(id, root): the smallest id reachable, for each id in edges (a, b); ids are long. Null ids and loops don't count.

    Large-star and small-star steps on written tables; the number of rounds follows the logarithm of the
    largest component's size. A star's centre may have any number of edges: minima are aggregated before the exchange, and
    `lookup` brings them to a hot centre's edges without shuffling those.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{prefix}-edges")
    while True:
        # of each node, the least among itself and its neighbours
        ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = written(ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{prefix}-least")
        # large star: larger neighbours of u go to the least node around u
        large = lookup(edges.select(F.col("u").alias("w"), F.col("v").alias("u")), least, ["u"]).select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct(), f"{prefix}-large")
        # small star: of the smaller neighbours of u, all go to the least
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{prefix}-down")
        step = lookup(large, down, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v")))
        step = written(step.distinct(), f"{prefix}-step")
        # done when each leaf has one centre, and no centre is a leaf
        n = step.count()
        leaves = step.select("u").distinct()
        if n == leaves.count() and not lookup(step.select(F.col("v").alias("u")), written(leaves, f"{prefix}-leaves"), ["u"]).limit(1).count():
            return step.select(F.col("u").alias("id"), F.col("v").alias("root"))
        edges = step


def task(f):
    """Decorator of a function for mapInArrow: when a task ends, its worker gives memory back instead of holding it while idle."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return run


def by_sorted_keys(keys: list[str]):
    """Decorator of f(key, arrow table) -> iterator of record batches: runs it on each run of equal keys.

    For mapInArrow over partitions that are sorted by keys; only one group is held at a time.
    """

    def wrap(f):
        @task
        def run(batches):
            import numpy as np
            import pyarrow as pa

            held, held_key = [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
                edge = np.zeros(batch.num_rows, bool)
                edge[0] = True
                for c in cols:
                    edge[1:] |= c[1:] != c[:-1]
                cuts = [*np.flatnonzero(edge).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    key = tuple(c[a] for c in cols)
                    if held and key != held_key:
                        yield from f(held_key, pa.Table.from_batches(held))
                        held = []
                    held_key = key
                    held.append(batch.slice(a, b - a))
            if held:
                yield from f(held_key, pa.Table.from_batches(held))

        return run

    return wrap

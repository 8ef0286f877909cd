"""Reading texts, corpora, settings and file listings, and writing results so that a mapping never outlives a failed write."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.operators import settings as settings_

# Fixed value: the longest text that is processed, in characters.
MOST_CHARS = 100_000
BLANK = r"^[\s\p{Z}\x1C-\x1F\x85]*$"
CASE = ("id string, text string, expected map<string,array<string>>, require_org boolean, forbidden array<string>, "
        "forbidden_person_values array<string>, recovery_exact boolean")
GOLD = "text string, entities array<struct<category:string,start:int,end:int,text:string>>"


def blank(text: Column) -> Column:
    """Null, empty, or white space only."""
    return text.isNull() | text.rlike(BLANK)


def status(text: Column, most: int = MOST_CHARS) -> Column:
    """blank, too_long or ok."""
    return F.when(blank(text), "blank").when(F.length(text) > most, "too_long").otherwise("ok")


def guard(df: DataFrame, text_col: str = "text", most: int = MOST_CHARS) -> tuple[DataFrame, DataFrame]:
    """(rows to process, rows rejected for their length, whole); blank rows are in neither."""
    s = status(F.col(text_col), most)
    return df.where(s == "ok"), df.where(s == "too_long")


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its files make fewer than half as many splits; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df._jdf.rdd().getNumPartitions() <= cores else df


def read_cases(spark: SparkSession, path: str, schema: str = CASE) -> DataFrame:
    """A corpus of one JSON array, or of JSON files of one each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """A row per settings file (path, raw and the validated fields)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return settings_.load(raw)


def set_aside(loaded: DataFrame, folder: str) -> DataFrame:
    """Write the corrupt blobs of read_settings to a quarantine table and return the rows, which hold defaults for them."""
    loaded.where("corrupt").select("path", "raw").write.mode("append").parquet(folder)
    return loaded


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of all files below a folder; contents aren't read. Paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))
    root = F.lit(path.rstrip("/") + "/")
    at = F.locate(path.rstrip("/") + "/", F.col("path"))
    return files.select(F.when(at > 0, F.substring(F.col("path"), at + F.length(root), F.length("path"))).otherwise(F.col("path")).alias("path"), "bytes")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_masked(masked: DataFrame, mapping: DataFrame, text_path: str, mapping_path: str, keys: list[str], text_col: str = "masked") -> bool:
    """Write masked texts, read them back and compare; only then write the mapping. False, and no mapping, if they differ.

    The comparison sums hashes of keys and text on both sides, so neither side is collected or sorted.
    """
    masked.select(*keys, text_col).write.parquet(text_path)

    def sums(df: DataFrame):
        h = F.xxhash64(*keys, text_col)
        return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(h, 32)).alias("a"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("b")).first()

    if sums(masked) != sums(masked.sparkSession.read.parquet(text_path)):
        return False
    mapping.write.parquet(mapping_path)
    return True


def write_restored(restored: DataFrame, path: str, keys: list[str], text_col: str = "restored", fmt: str = "parquet", mode: str = "errorifexists", **options) -> None:
    """Write texts with their originals put back, to the place that the caller names and nowhere else: keys and text only, no mapping. An
    existing target is an error unless mode says otherwise."""
    if not path:
        raise ValueError("restored texts are only written to a path that is given")
    restored.select(*keys, text_col).write.format(fmt).mode(mode).options(**options).save(path)


def save_settings(df: DataFrame, path: str) -> None:
    """Replace a settings table. It is written beside the target first; only when it is complete does it take the target's name, and the old
    one is kept until then. A failed write leaves the old table as it was."""
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.json(new)
        had = files.exists(target)
        if had and not files.rename(target, hadoop(old)):
            raise OSError(f"{path} could not be set aside")
        if not files.rename(hadoop(new), target):
            if had:
                files.rename(hadoop(old), target)
            raise OSError(f"{path} could not be replaced")
        if had:
            files.delete(hadoop(old), True)
    finally:
        files.delete(hadoop(new), True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors and driver share: spark.checkpoint.dir. Only a local master may do without, and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "textveil")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def computed(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder: what several results use is computed once, and survives the loss of executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()

"""Comparing findings with what was expected: precision and recall, quantiles, verdicts of cases, size totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Classes of the inventory report, in order.
CLASSES = (
    "UIE ONNX Model", "UIE tokenizer/config assets", "ONNX Runtime", "NumPy",
    "Python Runtime", "PySide6 / Qt", "Project Code / Resources", "Other Python Packages",
    "Other Native DLL", "Metadata / Misc", "Unknown",
)
# What makes a file one of a class. Each class has alternatives, each a number of conditions (kind, value or values) that must all
# hold; the first class that applies is a file's. Kinds: path ends, folder or file below the root, path contains, path starts, file name,
# file name starts, suffix, path matches.
INVENTORY = (
    ("UIE ONNX Model", [[("ends", "models/uie-nano-onnx/model.onnx")]]),
    ("UIE tokenizer/config assets", [[("below", "models/uie-nano-onnx/")]]),
    ("ONNX Runtime", [[("contains", "onnxruntime")]]),
    ("NumPy", [[("below", "numpy")], [("contains", "numpy.libs")]]),
    ("PySide6 / Qt", [[("contains", "pyside6")], [("contains", "shiboken6")], [("below", "qt")]]),
    ("Project Code / Resources", [[("name", "app.exe")]]),
    ("Python Runtime", [[("name", "python312.dll")], [("name", "base_library.zip")], [("starts", "_internal/python")], [("starts", "_internal/"), ("name starts", "_"), ("suffix", ".pyd")]]),
    ("Other Python Packages", [[("matches", "coloredlogs|flatbuffers|humanfriendly|mpmath|packaging|protobuf|pyreadline|sympy|pynput|six")]]),
    ("Other Native DLL", [[("suffix", ".dll")], [("suffix", ".pyd")]]),
    ("Metadata / Misc", [[("matches", r"(^|/)[^/]*\.(dist-info|egg-info)(/|$)")], *[[("suffix", x)] for x in (".py", ".pyc", ".zip", ".json", ".txt", ".md", ".dat")]]),
)
MIB = 1048576


def category_counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by, "category").agg(F.count(F.lit(1)).alias("n"))


def group_occurrences(findings: DataFrame, *by: str) -> DataFrame:
    """A row per (category, value without case): the first value seen, its number of occurrences, and a label with the number if over one."""
    rows = findings.groupBy(*by, "category", F.lower("value").alias("folded")).agg(F.min_by("value", "start").alias("value"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("label", F.when(F.col("n") > 1, F.concat("value", F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col("value")))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def precision_recall(gold: DataFrame, found: DataFrame, keys: list[str], by: str = "category") -> DataFrame:
    """tp, fp, fn, precision, recall and f1 for each value of `by`, matching distinct rows on keys."""
    g = gold.select(by, *keys).distinct().withColumn("g", F.lit(1))
    f = found.select(by, *keys).distinct().withColumn("f", F.lit(1))
    both = g.join(f, [by, *keys], "full")
    counts = both.groupBy(by).agg(F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    counts = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return counts.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def quantiles(df: DataFrame, value: str, *by: str, buckets: int = 200) -> DataFrame:
    """n, median = the item n // 2 and p95 = the item max(0, int(0.95 n) - 1) of the sorted values, not interpolated.

    No group is sorted as a whole: approximate quantiles cut each group into buckets, counts per bucket tell which of them hold the
    two ranks, and only those buckets' values are counted one by one. The result doesn't depend on where the cuts are.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    cuts = rows.groupBy(*by).agg(F.percentile_approx("v", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("cuts"))
    null_safe = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    placed = rows.alias("r").join(cuts.alias("c"), null_safe(_of("r", by), _of("c", by))).select(*[F.col(f"r.{c}") for c in by], "v", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("bucket"))
    counts = placed.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy("bucket"))
    counts = counts.withColumns({"upto": upto, "n": F.sum("c").over(Window.partitionBy(*by))})
    ranks = {"median": F.floor(F.col("n") / 2), "p95": F.greatest(F.lit(0), F.floor(F.col("n") * 95 / 100) - 1)}
    holds = lambda r: (F.col("upto") > r) & (F.col("upto") - F.col("c") <= r)
    wanted = counts.where(holds(ranks["median"]) | holds(ranks["p95"])).select(*by, "bucket", "n", (F.col("upto") - F.col("c")).alias("base"))
    values = placed.alias("r").join(wanted.alias("w"), [*null_safe(_of("r", by), _of("w", by)), F.col("r.bucket") == F.col("w.bucket")]).select(*[F.col(f"r.{c}") for c in by], "r.bucket", "v", "n", "base")
    values = values.groupBy(*by, "bucket", "n", "base", "v").agg(F.count(F.lit(1)).alias("c"))
    values = values.withColumn("upto", F.col("base") + F.sum("c").over(Window.partitionBy(*by, "bucket").orderBy("v")))
    return values.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(holds(r), F.col("v"))).alias(name) for name, r in ranks.items()])


def _of(alias: str, columns) -> dict[str, Column]:
    return {c: F.col(f"{alias}.{c}") for c in columns}


def values_by_category(findings: DataFrame, *by: str) -> DataFrame:
    """Per text, a map from category to its distinct values, sorted."""
    one = findings.groupBy(*by, "category").agg(F.array_sort(F.collect_set("value")).alias("values"))
    return one.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "values")))).alias("actual"))


def verdicts(cases: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """cases with `passed`: all expected values found (organisations may contain or be contained in what was found), required organisations
    present, forbidden categories and persons absent."""
    df = cases.join(actual, key, "left")
    none = F.array().cast("array<string>")
    got = lambda c: F.coalesce(F.try_element_at("actual", c), none)
    covered = lambda c, values: F.when(c == "ORG", F.forall(values, lambda e: F.exists(got(F.lit("ORG")), lambda v: v.contains(e) | e.contains(v)))).otherwise(F.size(F.array_except(values, got(c))) == 0)
    expected = F.coalesce(F.forall(F.map_entries("expected"), lambda e: covered(e["key"], e["value"])), F.lit(True))
    required = ~F.coalesce("require_org", F.lit(False)) | (F.size(got(F.lit("ORG"))) > 0)
    persons = F.size(F.array_intersect(F.coalesce("forbidden_person_values", none), got(F.lit("PERSON")))) == 0
    absent = F.forall(F.coalesce("forbidden", none), lambda c: F.size(got(c)) == 0)
    return df.withColumn("passed", expected & required & persons & absent)


def class_of(path: Column, rules=INVENTORY, other: str = CLASSES[-1]) -> Column:
    """The first class of rules (see INVENTORY) that a relative path belongs to, without case; `other` if none."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.substring_index(p, "/", -1)
    tests = {
        "ends": p.endswith, "starts": p.startswith, "contains": p.contains, "matches": p.rlike, "name starts": name.startswith,
        "below": F.concat(F.lit("/"), p).contains, "name": lambda v: name == F.lit(v), "suffix": lambda v: F.regexp_extract(name, r"[^.](\.[^.]+)$", 1) == F.lit(v),
    }
    out = None
    for label, alternatives in rules:
        holds = F.lit(False)
        for conditions in alternatives:
            every = F.lit(True)
            for kind, value in conditions:
                every = every & tests[kind](f"/{value}" if kind == "below" else value)
            holds = holds | every
        out = F.when(holds, label) if out is None else out.when(holds, label)
    return F.lit(other) if out is None else out.otherwise(other)


def inventory(files: DataFrame) -> DataFrame:
    """A row per class, those without files too, in the report's order: files, bytes, MiB and percent of all bytes."""
    spark = files.sparkSession
    classes = spark.createDataFrame(list(enumerate(CLASSES)), "position int, class string")
    sums = files.groupBy(class_of(F.col("path")).alias("class")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    rows = classes.join(F.broadcast(sums), "class", "left")  # eleven rows at most on either side
    rows = rows.select("position", "class", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy())
    return rows.withColumns({"mib": F.col("bytes") / MIB, "percent": F.when(total > 0, F.col("bytes") * 100.0 / total).otherwise(0.0)})


def largest(files: DataFrame, n: int = 50) -> DataFrame:
    """The n largest files, with class and MiB; equal sizes by path."""
    return files.orderBy(F.desc("bytes"), "path").limit(n).select("path", "bytes", class_of(F.col("path")).alias("class"), (F.col("bytes") / MIB).alias("mib"))

"""Document quality by hierarchical empirical Bayes: a document's own evidence, its path's and its host's.

Document evidence: a logistic regression over a few measures of a text (shares of character kinds, repetition of words and
lines, lengths). Every document then counts with its label, if that may be learnt
from, or else with its probability, and sums of these by host and path are grouped aggregates. Shrinkage:
  host  = (sum + k m) / (n + k), m the mean over all documents, k from the moments of the hosts' means;
  path  = (sum + j host) / (n + j), j likewise from the paths' means within hosts;
so that sparse sites stay near the prior of the level above. A document's score is its own log odds plus the log odds of
its path, less the prior's log odds. Its own part is taken out of the sums of path, host and all, so that its label can't
come back to it by way of its site.

The classifier is fitted on at most SAMPLE labelled ids, one text of each, with at most `most_chars` characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textveil.llm.common import bounded_sample, fold, lookup, named, table, task, written
from textveil.llm.toxicity import logistic

SAMPLE = 8000
SAMPLE_CHARS = 20_000
CUT = 0.5
#: Prior strengths are kept in this range, in documents.
STRENGTH = (2.0, 1000.0)
MEASURES = ("letters", "digits", "spaces", "symbols", "upper", "non_ascii", "distinct", "top_word", "word_length", "repeated_lines", "log_words", "bars")


def site(url: Column) -> tuple[Column, Column]:
    """(host, host with the first path segment) of a column of addresses."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return host, F.concat_ws("/", host, F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1))


def measure(text: str) -> list[float]:
    """MEASURES of a whole text."""
    import math
    from collections import Counter

    import numpy as np

    data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = max(1, int(data.sum()))
    lower, upper, digits = int(data[97:123].sum()), int(data[65:91].sum()), int(data[48:58].sum())
    high, space = int(data[128:].sum()), int(data[[9, 10, 11, 12, 13, 32]].sum())
    words = text.split()
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    return [(lower + upper + high) / n, digits / n, space / n, (n - lower - upper - digits - high - space) / n, upper / n, high / n, len(count) / w,
            max(count.values(), default=0) / w, min(30.0, (n - space) / w) / 10, 1 - len(set(lines)) / max(1, len(lines)), math.log1p(len(words)) / 10, int(data[124]) / w]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_chars: int = SAMPLE_CHARS):
    """(weights, means, deviations) of the document classifier, or None without labelled rows of both classes. Labels hold an id once; of
    rows with equal id the smallest text counts."""
    import numpy as np

    ids = bounded_sample(labels.select(named(id_col).alias("id"), (named(label_col) == 1).alias("good")), "id", SAMPLE)
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= most_chars)).join(F.broadcast(ids), "id")
    got = rows.groupBy("id", "good").agg(F.min("t").alias("t")).collect()  # no more rows than ids
    got.sort(key=lambda r: r["id"])
    y = np.array([float(r["good"]) for r in got])
    if len(set(y.tolist())) < 2:
        return None
    x = np.array([measure(r["t"]) for r in got])
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / deviation, -6, 6)
    return logistic(np.c_[z, z * z], y, l2=1.0), mean, deviation


def document_scores(docs: DataFrame, model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """`keep` and p, the classifier's probability from the text alone; null texts count as empty, and without a model p is 0.5."""
    src = docs.select(*keep, F.coalesce(named(text_col), F.lit("")).alias("quality_text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("p", T.DoubleType())])

    @task
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if model is None:
                p = np.full(batch.num_rows, 0.5)
            else:
                w, mean, deviation = model
                x = np.array([measure(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(batch.num_rows, len(MEASURES))
                z = np.clip((x - mean) / deviation, -6, 6)
                p = 1 / (1 + np.exp(-np.clip(np.c_[z, z * z] @ w[:-1] + w[-1], -12, 12)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*batch.schema.names[:-1], "p"])

    return src.mapInArrow(run, schema)


def strength(within, between: float, mean: float) -> float:
    """Prior strength by moments: the mean's binomial variance over the variance between groups, less one."""
    import math

    if not between or between <= 0 or math.isnan(between):
        return STRENGTH[1]
    return min(STRENGTH[1], max(STRENGTH[0], mean * (1 - mean) / between - 1))


def _key(c: str) -> Column:
    """A column as a string that keeps null apart from the empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))


def posteriors(evidence: DataFrame) -> tuple[DataFrame, dict]:
    """Of rows (host, path, e): a row per path with its own and its host's sums and the host's posterior (host, path, h, p, s, n, hs,
    hn, host_posterior), and the constants sum, n, mean, k and j.

    The three passes aggregate to paths, hosts and one row; strengths come from variances between groups, less what
    counting n documents adds by itself.
    """
    paths = written(evidence.groupBy("host", "path").agg(F.sum("e").alias("s"), F.count(F.lit(1)).alias("n")).withColumns({"h": _key("host"), "p": _key("path")}), "quality-paths")
    hosts = written(paths.groupBy("h").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn")), "quality-hosts")
    total = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).first()
    mean = min(1 - 1e-6, max(1e-6, total["s"] / total["n"])) if total["n"] else 0.5
    noise = mean * (1 - mean)
    between = hosts.where("hn > 1").agg((F.sum(F.col("hn") * ((F.col("hs") / F.col("hn") - mean) ** 2 - noise / F.col("hn"))) / F.sum("hn")).alias("v")).first()["v"]
    k = strength(noise, between, mean)
    paths = lookup(paths, hosts, ["h"]).withColumn("host_posterior", (F.col("hs") + k * mean) / (F.col("hn") + k))
    inside = paths.where("n > 1").agg((F.sum(F.col("n") * ((F.col("s") / F.col("n") - F.col("host_posterior")) ** 2 - F.col("host_posterior") * (1 - F.col("host_posterior")) / F.col("n"))) / F.sum("n")).alias("v")).first()["v"]
    return paths, {"sum": float(total["s"] or 0.0), "n": int(total["n"] or 0), "mean": mean, "k": k, "j": strength(noise, inside, mean)}


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = CUT, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, host, path, p, host_posterior, path_posterior, score, predicted): one row per input row.

    `labels` holds the rows to learn from; null labels and ids don't count, and an id with two labels is good if one says so. Null hosts
    are one host, null paths one path of a host. Both posteriors are without the document's own part. Null and empty texts and texts
    of any length are scored; repeated rows each count. Without labels p is 0.5 for all; an empty table gives no rows; other columns are ignored.
    """
    known = labels.where(named(id_col).isNotNull() & named(label_col).isNotNull()).groupBy(named(id_col).alias("doc_id")).agg(F.max(named(label_col)).alias("label"))
    model = fit(docs, known.withColumnsRenamed({"doc_id": id_col, "label": label_col}), id_col, text_col, label_col, most_chars)
    scored = document_scores(docs, model, [named(id_col).alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path")], text_col)
    known = written(known.select("doc_id", (F.col("label") == 1).cast("double").alias("label")), "quality-labels")
    evidence = lookup(written(scored, "quality-scores"), known, ["doc_id"], "left").select("doc_id", "host", "path", _key("host").alias("h"), _key("path").alias("q"), "p", F.coalesce("label", "p").alias("e"))
    evidence = written(evidence, "quality-evidence")
    paths, c = posteriors(evidence)
    paths = written(paths.select("h", F.col("p").alias("q"), "s", "n", "hs", "hn"), "quality-posteriors")
    out = lookup(evidence, paths, ["h", "q"])
    bounded = lambda x: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), x))
    mean = bounded((F.lit(c["sum"]) - F.col("e")) / (c["n"] - 1)) if c["n"] > 1 else F.lit(0.5)
    out = out.withColumn("mean", mean)
    out = out.withColumn("host_posterior", (F.col("hs") - F.col("e") + c["k"] * F.col("mean")) / (F.col("hn") - 1 + c["k"]))
    out = out.withColumn("path_posterior", (F.col("s") - F.col("e") + c["j"] * F.col("host_posterior")) / (F.col("n") - 1 + c["j"]))
    z = _logit(F.col("p")) + _logit(F.col("path_posterior")) - _logit(F.col("mean"))
    out = out.withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", "host", "path", "p", "host_posterior", "path_posterior", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    """documents by source (host) and source and language (path); labels of rows with crc32(doc_id as text) mod 5 = 0 are held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    out = classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
    return out.withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))

"""Evaluation, settings, verdicts, inventories and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textveil.functions.catalog import DEFAULTS
from textveil.operators import evaluate, masking, recovery, settings
from textveil.operators.detect import detect, exploded
from textveil.plans.common import frame, table, values_sql
from textveil.plans.documents import FINDINGS
from textveil.sources import io

# Gold spans made from the findings: every third is missing, and every fifth document has one that isn't there.
_GOLD_SQL = FINDINGS + """, found AS (SELECT doc_id, category, "start", "end", value FROM f),
gold AS (SELECT * FROM found WHERE "start" % 3 <> 0 UNION ALL SELECT doc_id, 'EMAIL', -1, -1, '' FROM documents WHERE doc_id % 5 = 0)"""


def _found(spark, sf_dir):
    return exploded(detect(table(spark, sf_dir, "documents", "doc_id", "text")), ["doc_id"]).select("doc_id", "category", "start", "end", "value")


def _found_once(spark, sf_dir):
    """For queries that use the findings more than once."""
    return io.computed(_found(spark, sf_dir))


def _gold(spark, sf_dir, found):
    extra = table(spark, sf_dir, "documents", "doc_id").where("doc_id % 5 = 0").select("doc_id", F.lit("EMAIL").alias("category"), F.lit(-1).cast("bigint").alias("start"), F.lit(-1).cast("bigint").alias("end"), F.lit("").alias("value"))
    return found.where("start % 3 <> 0").unionByName(extra)


KEYS = ["doc_id", "start", "end", "value"]


def eval_prf(spark, sf_dir):
    found = _found_once(spark, sf_dir)
    out = evaluate.precision_recall(_gold(spark, sf_dir, found), found, KEYS)
    return out.select("category", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def set_compare(spark, sf_dir):
    found = _found_once(spark, sf_dir)
    gold = _gold(spark, sf_dir, found)
    parts = {"both": gold.intersect(found), "missed": gold.subtract(found), "extra": found.subtract(gold)}
    out = None
    for name, df in parts.items():
        one = df.groupBy(F.lit(name).alias("part"), "category").agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def eval_quantiles(spark, sf_dir):
    return evaluate.quantiles(table(spark, sf_dir, "events"), "value", "event_type")


def values_by_category(spark, sf_dir):
    out = evaluate.values_by_category(_found(spark, sf_dir), "doc_id")
    return out.select("doc_id", F.explode("actual").alias("category", "values")).select("doc_id", "category", F.array_join("values", "|").alias("values"))


# (id, text, expected, require_org, forbidden, forbidden persons, verdict)
CASES = [
    ("phone", "丁晓核对了账目，电话13900001234。", {"PHONE": ["13900001234"]}, None, None, None, True),
    ("verb", "程一诺负责汇总季度数字。", {"PERSON": ["程一诺"]}, None, None, None, True),
    ("compound", "上官云飞已经提交了新图纸。", {"PERSON": ["上官云飞"]}, None, None, None, True),
    ("roles", "负责人：姚安然；审核人：叶青；经办人贺知秋，审批人为司马长风。", {"PERSON": ["姚安然", "叶青", "贺知秋", "司马长风"]}, None, None, None, True),
    ("log", "WARN 03:15 owner=范蓉 job=nightly", {"PERSON": ["范蓉"]}, None, None, None, True),
    ("password", "后台口令：Garden_Gate_7781!", {"PASSWORD": ["Garden_Gate_7781!"]}, None, None, None, True),
    ("api key", "API Key 为 made-up-0c9d1e77aa5b4f21", {"API_KEY": ["made-up-0c9d1e77aa5b4f21"]}, None, None, None, True),
    ("token", "Token：`night-55aa90cc1177`", {"TOKEN": ["night-55aa90cc1177"]}, None, None, None, True),
    ("card", "退款到5500005555555559。", {"BANK_CARD": ["5500005555555559"]}, None, None, None, True),
    ("addresses", "网关172.16.8.9，备用fe80::1c2d:3e4f。", {"IP": ["172.16.8.9", "fe80::1c2d:3e4f"]}, None, None, None, True),
    ("domain", "说明放在docs.harbor.example.com里。", {"DOMAIN": ["docs.harbor.example.com"]}, None, None, None, True),
    ("no domain", "a.size order.total settings.retry notes.pdf v4.5.6 2.7.18", {}, None, ["DOMAIN"], None, True),
    ("no key", "api_key_rotation=on apikey_label=demo API Key 说明", {}, None, ["API_KEY"], None, True),
    ("no person", "何处停车还没有写明。高可用方案上线了。周报今天写完。于今日起生效。", {}, None, ["PERSON"], None, True),
    ("no term", "叶青负责清理缓存。", {"PERSON": ["叶青"]}, None, None, ["缓存"], True),
    ("collision", "<EMAIL_1> 其实是qiaolin@example.org。", {"EMAIL": ["qiaolin@example.org"]}, None, None, None, True),
    ("organisation", "贺知秋在远山软件有限公司上班。", {}, True, None, None, False),
    ("missing", "nothing", {"EMAIL": ["a@b.com"]}, None, None, None, False),
    ("forbidden", "a@b.com", {}, None, ["EMAIL"], None, False),
]


def corpus_verdicts(spark, sf_dir):
    """Detection with rule-based names on literal cases, judged, and whether masking and restoring gives the text back."""
    cases = frame(spark, [(i, t, e, r, f, p) for i, t, e, r, f, p, _ in CASES], "case string, text string, expected map<string,array<string>>, require_org boolean, forbidden array<string>, forbidden_person_values array<string>")
    masked = masking.mask(detect(cases.select("case", "text"), names=True))
    actual = evaluate.values_by_category(exploded(masked, ["case"]), "case")
    judged = evaluate.verdicts(cases, actual, "case").select("case", "passed")
    back = masked.select("case", (recovery.restore_text(F.col("masked"), masking.mapping(F.col("findings")))["text"] == F.col("text")).alias("recovered"))
    return judged.join(back, "case")


def verdict_totals(spark, sf_dir):
    out = corpus_verdicts(spark, sf_dir)
    return out.agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed"), F.count_if("recovered").alias("recovered"))


# (blob, corrupt, terms, hotkey, warning, startup, PERSON and SYSTEM defaults)
SETTINGS = [
    ('{"dictionary":[{"term":"a","category":"ORG","default_selected":true},{"term":" ","category":"ORG","default_selected":true},{"term":"b","category":"NOPE","default_selected":true},{"term":"c","category":"ID","default_selected":"yes"},7],"hotkey":"x","high_risk_warning":false,"category_defaults":{"PERSON":false,"SYSTEM":1,"NOPE":true},"startup":true}', False, "a", "x", False, True, False, False),
    ('{"hotkey":"","high_risk_warning":"false","startup":0,"dictionary":{"a":1},"category_defaults":[1]}', False, "", "<ctrl>+<shift>+s", True, False, True, False),
    ("{}", False, "", "<ctrl>+<shift>+s", True, False, True, False),
    ("[1,2]", True, "", "<ctrl>+<shift>+s", True, False, True, False),
    ("not json", True, "", "<ctrl>+<shift>+s", True, False, True, False),
    ('{"hotkey":5,"category_defaults":{"SYSTEM":true}}', False, "", "<ctrl>+<shift>+s", True, False, True, True),
]


def settings_validate(spark, sf_dir):
    df = settings.load(frame(spark, [(i, r) for i, (r, *_) in enumerate(SETTINGS)], "id bigint, raw string"))
    return df.select("id", "corrupt", F.array_join(F.transform("dictionary", lambda e: e["term"]), "|").alias("terms"), "hotkey", "high_risk_warning", "startup",
                     F.element_at("category_defaults", "PERSON").alias("person"), F.element_at("category_defaults", "SYSTEM").alias("system"))


def defaults_merge(spark, sf_dir):
    df = frame(spark, [({"PERSON": False, "DEPARTMENT": True, "NEW": True},)], "over map<string,boolean>")
    return df.select(F.explode(settings.merged(settings.default_map(), F.col("over"))).alias("category", "selected"))


PATHS = [
    ("_internal/models/uie-nano-onnx/model.onnx", "UIE ONNX Model"), ("_internal/models/uie-nano-onnx/vocab.txt", "UIE tokenizer/config assets"), ("_internal/onnxruntime/capi/x.dll", "ONNX Runtime"),
    ("_internal/numpy/core.pyd", "NumPy"), ("_internal/PySide6/Qt6Core.dll", "PySide6 / Qt"), ("app.exe", "Project Code / Resources"), ("_internal/python312.dll", "Python Runtime"), ("_internal/_ssl.pyd", "Python Runtime"),
    ("_internal/six.py", "Other Python Packages"), ("_internal/libcrypto.dll", "Other Native DLL"), ("_internal/x-1.0.dist-info/RECORD", "Metadata / Misc"), ("readme.txt", "Metadata / Misc"), ("_internal\\data\\thing.bin", "Unknown"), (".txt", "Unknown"),
]


def _files(spark):
    return frame(spark, [(p, (i + 1) * 1000) for i, (p, _) in enumerate(PATHS)], "path string, bytes bigint")


def inventory_classes(spark, sf_dir):
    return _files(spark).select("path", evaluate.class_of(F.col("path")).alias("class"))


def inventory_totals(spark, sf_dir):
    out = evaluate.inventory(_files(spark))
    return out.select(F.col("position").cast("bigint").alias("position"), "class", "files", "bytes", F.round("mib", 9).alias("mib"), F.round("percent", 9).alias("percent"))


def _totals_rows():
    sums = {c: [0, 0] for c in evaluate.CLASSES}
    for i, (_, c) in enumerate(PATHS):
        sums[c][0] += 1
        sums[c][1] += (i + 1) * 1000
    total = sum(b for _, b in sums.values())
    return [(k, c, sums[c][0], sums[c][1], round(sums[c][1] / evaluate.MIB, 9), round(sums[c][1] * 100.0 / total, 9)) for k, c in enumerate(evaluate.CLASSES)]


def inventory_top50(spark, sf_dir):
    """Parts as files: their size number stands for bytes."""
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("_internal/"), F.col("p_partkey").cast("string"), F.lit(".dll")).alias("path"), (F.col("p_size") * 1000 + F.col("p_partkey") % 7).cast("bigint").alias("bytes"))
    return evaluate.largest(files).select("path", "bytes", "class")


def file_listing(spark, sf_dir):
    """All files below the test folder. Their names and sizes hang on how the tables were written, so there is no SQL."""
    return io.list_files(spark, sf_dir)


def label_shares(spark, sf_dir):
    """Labels by language: counts with empty denominators as 0."""
    df = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents", "doc_id", "lang"), "doc_id")
    out = df.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    return out.select("lang", "good", "bad", F.round(evaluate.ratio(F.col("good"), F.col("good") + F.col("bad")), 9).alias("share"))


PLANS = {
    "eval_prf": (eval_prf, _GOLD_SQL + """, j AS (SELECT coalesce(g.category, x.category) AS category, g.doc_id IS NOT NULL AS g, x.doc_id IS NOT NULL AS x FROM gold g FULL JOIN found x ON g.doc_id = x.doc_id AND g.category = x.category AND g."start" = x."start" AND g."end" = x."end" AND g.value = x.value),
n AS (SELECT category, count(*) FILTER (g AND x) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT x) AS fn FROM j GROUP BY category),
p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r FROM n)
SELECT category, tp, fp, fn, round(CAST(p AS DOUBLE), 9) AS precision, round(CAST(r AS DOUBLE), 9) AS recall, round(CAST(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS DOUBLE), 9) AS f1 FROM p"""),
    "set_compare": (set_compare, _GOLD_SQL + """SELECT 'both' AS part, category, count(*) AS n FROM (SELECT * FROM gold INTERSECT SELECT * FROM found) GROUP BY category
UNION ALL SELECT 'missed', category, count(*) FROM (SELECT * FROM gold EXCEPT SELECT * FROM found) GROUP BY category UNION ALL SELECT 'extra', category, count(*) FROM (SELECT * FROM found EXCEPT SELECT * FROM gold) GROUP BY category"""),
    "eval_quantiles": (eval_quantiles, "SELECT event_type, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS median, list_sort(list(value))[greatest(0, count(*) * 95 // 100 - 1) + 1] AS p95 FROM events GROUP BY event_type"),
    "values_by_category": (values_by_category, FINDINGS + "SELECT doc_id, category, array_to_string(list_sort(list(DISTINCT value)), '|') AS \"values\" FROM f GROUP BY doc_id, category"),
    "corpus_verdicts": (corpus_verdicts, values_sql([(c[0], c[-1], True) for c in CASES], '"case" VARCHAR, passed BOOLEAN, recovered BOOLEAN')),
    "verdict_totals": (verdict_totals, values_sql([(len(CASES), sum(c[-1] for c in CASES), len(CASES))], "cases BIGINT, passed BIGINT, recovered BIGINT")),
    "settings_validate": (settings_validate, values_sql([(i, *r[1:]) for i, r in enumerate(SETTINGS)], "id BIGINT, corrupt BOOLEAN, terms VARCHAR, hotkey VARCHAR, high_risk_warning BOOLEAN, startup BOOLEAN, person BOOLEAN, system BOOLEAN")),
    "defaults_merge": (defaults_merge, values_sql(list((DEFAULTS | {"PERSON": False, "DEPARTMENT": True, "NEW": True}).items()), "category VARCHAR, selected BOOLEAN")),
    "inventory_classes": (inventory_classes, values_sql(PATHS, 'path VARCHAR, "class" VARCHAR')),
    "inventory_totals": (inventory_totals, values_sql(_totals_rows(), 'position BIGINT, "class" VARCHAR, files BIGINT, bytes BIGINT, mib DOUBLE, percent DOUBLE')),
    "inventory_top50": (inventory_top50, "SELECT path, bytes, 'Other Native DLL' AS \"class\" FROM (SELECT '_internal/' || p_partkey || '.dll' AS path, CAST(p_size * 1000 + p_partkey % 7 AS BIGINT) AS bytes FROM part) ORDER BY bytes DESC, path LIMIT 50"),
    "file_listing": (file_listing, None),
    "label_shares": (label_shares, "SELECT lang, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, round(count(*) FILTER (quality = 1) / CAST(count(*) AS DOUBLE), 9) AS share FROM labels JOIN documents USING (doc_id) GROUP BY lang"),
}

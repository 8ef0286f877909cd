"""Detection, masking, dictionary, mapping and recovery over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textveil.functions.catalog import CATEGORIES, DEFAULTS, default_selected, known, priority, risk
from textveil.functions.overlaps import resolve
from textveil.operators import detect as D
from textveil.operators import evaluate, masking, recovery
from textveil.plans.common import frame, spans_sql, table, values_sql
from textveil.plans.rules import PLANS as RULE_PLANS
from textveil.sources.io import computed, status

RULE_OF = {"rule_email": "EMAIL", "rule_bank_card": "BANK_CARD", "rule_ipv4": "IP", "rule_token": "TOKEN", "rule_domain": "DOMAIN"}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")


def _found(spark, sf_dir):
    return D.detect(_docs(spark, sf_dir))


def _masked(spark, sf_dir):
    return masking.mask(_found(spark, sf_dir))


def _rows(found, *more):
    return D.exploded(found, ["doc_id", *more])


# The oracle: the rules that occur in documents, one by one; a candidate stands if none of a better rank overlaps it.
_CANDIDATES = " UNION ALL ".join(
    f"""SELECT doc_id, '{c}' AS category, {CATEGORIES[c][1]} AS priority, {i} AS rule, "start", "end", value FROM ({RULE_PLANS[r][1]})""" for i, (r, c) in enumerate(RULE_OF.items()))
_PHONE = spans_sql("SELECT doc_id, text FROM documents", "doc_id", "text", r"(?:\+86[- ]?)?[0-9]+", r"regexp_full_match(value, '(\+86[- ]?)?1[3-9][0-9]{9}')")
_CARD = spans_sql("SELECT doc_id, text FROM documents", "doc_id", "text", r"[0-9]+[Xx]?", r"regexp_full_match(value, '[0-9]{17}[0-9Xx]')")
_CANDIDATES += f""" UNION ALL SELECT doc_id, 'PHONE', 3, 5, "start", "end", value FROM ({_PHONE}) UNION ALL SELECT doc_id, 'ID_CARD', 3, 6, "start", "end", value FROM ({_CARD})"""
FINDINGS = f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, "start" - "end", "start", rule) AS rank FROM ({_CANDIDATES})),
f AS MATERIALIZED (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.rank < c.rank AND b."start" < c."end" AND c."start" < b."end"))
"""
_RISK = "CASE " + " ".join(f"WHEN category = '{c}' THEN '{v[0]}'" for c, v in CATEGORIES.items()) + " ELSE 'low' END"

# Masked text: numbers by first occurrence, then gaps and placeholders in order.
_NUMBERED = FINDINGS + """,
k AS (SELECT doc_id, category, lower(value) AS folded, min("start") AS first FROM f GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY first) AS n FROM k),
r AS MATERIALIZED (SELECT f.*, '<' || f.category || '_' || n.n || '>' AS replacement, coalesce(lag("end") OVER (PARTITION BY f.doc_id ORDER BY "start"), 0) AS before
  FROM f JOIN n ON f.doc_id = n.doc_id AND f.category = n.category AND lower(f.value) = n.folded)
"""


def _assembled(piece: str) -> str:
    return f"""(SELECT d.doc_id, coalesce((SELECT string_agg(d.text[r.before + 1:r."start"] || {piece}, '' ORDER BY r."start") || d.text[max(r."end") + 1:] FROM r WHERE r.doc_id = d.doc_id), d.text) AS masked, d.text FROM documents d)"""


def detect_documents(spark, sf_dir):
    return _rows(_found(spark, sf_dir))


def detect_category_counts(spark, sf_dir):
    return evaluate.category_counts(_rows(_found(spark, sf_dir)))


def detect_lang_rollup(spark, sf_dir):
    rows = _rows(_found(spark, sf_dir), "lang")
    return rows.rollup("lang", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk") == "high").alias("high_risk"))


def occurrence_groups(spark, sf_dir):
    return evaluate.group_occurrences(_rows(_found(spark, sf_dir)), "doc_id").select("doc_id", "category", "folded", "value", "n", "label")


def mask_documents(spark, sf_dir):
    return _masked(spark, sf_dir).select("doc_id", "masked", F.size("findings").cast("bigint").alias("n_findings"))


def mask_findings(spark, sf_dir):
    return _rows(_masked(spark, sf_dir)).select("doc_id", "category", "start", "end", "value", "replacement")


def mask_high_risk_only(spark, sf_dir):
    found = _found(spark, sf_dir).withColumn("findings", D.high_risk_only(F.col("findings")))
    return masking.mask(found).select("doc_id", "masked")


def mask_group_toggle(spark, sf_dir):
    """Every e-mail address ending in 7.example.com is left as it is."""
    found = _found(spark, sf_dir)
    off = F.transform("findings", lambda f: f.withField("selected", f["selected"] & ~((f["category"] == "EMAIL") & F.lower(f["value"]).endswith("7.example.com"))))
    return masking.mask(found.withColumn("findings", off)).select("doc_id", "masked")


def unmasked_high_risk(spark, sf_dir):
    off = F.transform("findings", lambda f: f.withField("selected", f["category"] != "EMAIL"))
    found = _found(spark, sf_dir).withColumn("findings", off)
    return found.select("doc_id", F.array_join(D.unmasked_high_risk(F.col("findings")), ",").alias("categories"))


def mapping_build(spark, sf_dir):
    return recovery.mapping_rows(_masked(spark, sf_dir), ["doc_id"])


def restore_documents(spark, sf_dir):
    out = _masked(spark, sf_dir).select("doc_id", recovery.restore_text(F.col("masked"), masking.mapping(F.col("findings"))).alias("r"))
    return out.select("doc_id", "r.text", "r.restored_count", "r.unknown_count")


def roundtrip_exact(spark, sf_dir):
    out = _masked(spark, sf_dir).select("doc_id", (recovery.restore_text(F.col("masked"), masking.mapping(F.col("findings")))["text"] == F.col("text")).alias("exact"))
    return out.agg(F.count(F.lit(1)).alias("documents"), F.count_if("exact").alias("exact"))


def restore_joined(spark, sf_dir):
    """Masked texts restored from a mapping table joined by document."""
    masked = computed(_masked(spark, sf_dir).select("doc_id", "masked", "findings"))
    maps = recovery.gather(recovery.mapping_rows(masked, ["doc_id"]), ["doc_id"])
    out = recovery.restore(masked.select("doc_id", F.concat("masked", F.lit(" <PHONE_99> <MADE_1>")).alias("text")), maps, ["doc_id"])
    return out.select("doc_id", "restored", "restored_count", "unknown_count")


# Literal cases: (text, mapping, restored text, restored, unknown).
RESTORE = [
    ("<PERSON_1>回复<PERSON_1>，地址<IP_1>", {"<PERSON_1>": "韩静", "<IP_1>": "10.0.0.1"}, "韩静回复韩静，地址10.0.0.1", 3, 0),
    ("保留<PERSON_99>和<ORG_1>", {"<PERSON_1>": "x"}, "保留<PERSON_99>和<ORG_1>", 0, 2),
    ("<MADE_UP_1>", {"<MADE_UP_1>": "x"}, "<MADE_UP_1>", 0, 0),
    ("<PERSON_0> <PERSON_-1> <person_1> <PERSON_01> PERSON_1", {"<PERSON_1>": "x"}, "<PERSON_0> <PERSON_-1> <person_1> <PERSON_01> PERSON_1", 0, 0),
    ("x<PERSON_1>y<ORG_8>", {"<PERSON_1>": "<ORG_8>"}, "x<ORG_8>y<ORG_8>", 1, 1),
    ("😀<DB_CREDENTIAL_12>", {"<DB_CREDENTIAL_12>": ""}, "😀", 1, 0),
    ("", {"<PERSON_1>": "x"}, "", 0, 0),
]


def restore_unknown(spark, sf_dir):
    df = frame(spark, [(i, t, m) for i, (t, m, *_) in enumerate(RESTORE)], "id bigint, text string, mapping map<string,string>")
    return df.withColumn("r", recovery.restore_text(F.col("text"), F.col("mapping"))).select("id", "r.text", "r.restored_count", "r.unknown_count")


# Texts with reserved placeholders: (text, dictionary terms' masked text).
NUMBERING = [
    ("<PERSON_1> 周明 <PERSON_2> 陈浩 <PERSON_5> 周明", "<PERSON_1> <PERSON_3> <PERSON_2> <PERSON_4> <PERSON_5> <PERSON_3>"),
    ("<ID_1> 123456 <EMAIL_1> a@example.com <ORG_1> 星河科技", "<ID_1> <ID_2> <EMAIL_1> <EMAIL_2> <ORG_1> <ORG_2>"),
    ("<PERSON_01> <PERSON_0> 周明", "<PERSON_01> <PERSON_0> <PERSON_1>"),
    ("A@x.com a@X.com b@x.com", "<EMAIL_1> <EMAIL_1> <EMAIL_2>"),
    ("password=\"\" pwd=a", "password=\"<PASSWORD_1>\" pwd=<PASSWORD_2>"),
    ("nothing here", "nothing here"),
]
TERMS = [("周明", "PERSON"), ("陈浩", "PERSON"), ("123456", "ID"), ("星河科技", "ORG")]


def reserved_numbering(spark, sf_dir):
    df = frame(spark, [(i, t) for i, (t, _) in enumerate(NUMBERING)], "id bigint, text string")
    return masking.mask(D.detect(df, dictionary=TERMS)).select("id", "masked")


def _made_intervals(spark, sf_dir):
    # three intervals per order line; categories, sources and places follow from its numbers
    li = table(spark, sf_dir, "lineitem")
    at = lambda e: F.expr(f"CAST({e} AS INT)")
    names = ["EMAIL", "IP", "PERSON", "ORG", "TOKEN", "PROJECT"]
    category = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("l_partkey") % 6 + 1).cast("int"))
    row = F.struct(category.alias("category"), at("l_suppkey % 50").alias("start"), at("l_suppkey % 50 + 1 + l_partkey % 9").alias("end"), F.lit("v").alias("value"),
                   F.when(F.col("l_linenumber") % 2 == 0, "rule").otherwise("dictionary").alias("source"), F.lit(True).alias("selected"),
                   F.expr("CAST(l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS INT)").alias("ord"))
    return li.groupBy("l_orderkey").agg(F.collect_list(row).alias("c"))


def resolve_overlaps(spark, sf_dir):
    out = _made_intervals(spark, sf_dir).select("l_orderkey", F.explode(resolve(F.col("c"))).alias("f"))
    return out.select("l_orderkey", "f.category", F.col("f.start").cast("bigint").alias("start"), F.col("f.end").cast("bigint").alias("end"), F.col("f.source").alias("source"))


_RESOLVE_SQL = """
WITH RECURSIVE c AS (
  SELECT l_orderkey, ['EMAIL', 'IP', 'PERSON', 'ORG', 'TOKEN', 'PROJECT'][l_partkey % 6 + 1] AS category, l_suppkey % 50 AS "start", l_suppkey % 50 + 1 + l_partkey % 9 AS "end",
    CASE WHEN l_linenumber % 2 = 0 THEN 'rule' ELSE 'dictionary' END AS source, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS ord
  FROM lineitem
), r AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE category WHEN 'EMAIL' THEN 3 WHEN 'IP' THEN 5 WHEN 'TOKEN' THEN 2 WHEN 'ORG' THEN 7 ELSE 6 END,
    CASE WHEN category = 'PERSON' THEN "start" - "end" ELSE 0 END, CASE source WHEN 'rule' THEN 1 ELSE 2 END, "start" - "end", "start", ord) AS rank FROM c
), g AS (
  SELECT l_orderkey, 0 AS rank, CAST([] AS STRUCT(s BIGINT, e BIGINT, rank BIGINT)[]) AS kept FROM (SELECT DISTINCT l_orderkey FROM r)
  UNION ALL
  SELECT g.l_orderkey, r.rank, CASE WHEN len(list_filter(g.kept, lambda k: r."end" > k.s AND r."start" < k.e)) = 0 THEN list_append(g.kept, {'s': r."start", 'e': r."end", 'rank': r.rank}) ELSE g.kept END
  FROM g JOIN r ON r.l_orderkey = g.l_orderkey AND r.rank = g.rank + 1
), last AS (
  SELECT l_orderkey, arg_max(kept, rank) AS kept FROM g GROUP BY l_orderkey
)
SELECT r.l_orderkey, r.category, CAST(r."start" AS BIGINT) AS "start", CAST(r."end" AS BIGINT) AS "end", r.source
FROM last JOIN r ON r.l_orderkey = last.l_orderkey AND list_contains(list_transform(last.kept, lambda k: k.rank), r.rank)
"""


def text_guard(spark, sf_dir):
    """Documents by what the guard says of them, under its own limit."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(status(F.col("text")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def dictionary_match(spark, sf_dir):
    """Part names and nation names as terms, texts made of parts."""
    terms = [("ring", "PROJECT"), ("small ring", "SYSTEM"), ("NATION_1", "ORG"), ("Brand#2", "CUSTOMER"), ("", "ORG")]
    df = table(spark, sf_dir, "part").select("p_partkey", F.expr("p_name || ' RING ringed, nation_1 nation_12 ' || p_brand").alias("text"))
    out = df.select("p_partkey", F.explode(D.dictionary_candidates(F.col("text"), terms)).alias("c"))
    return out.select("p_partkey", "c.category", F.col("c.start").cast("bigint").alias("start"), F.col("c.end").cast("bigint").alias("end"), F.col("c.value").alias("value"), F.col("c.selected").alias("selected"))


def dictionary_large(spark, sf_dir):
    """Thousands of terms: the names of all nations and customers, through the Arrow function. Terms travel with the function, up
    to its limit."""
    names_ = [(r[0], "CUSTOMER") for r in table(spark, sf_dir, "customer", "c_name").orderBy("c_name").collect()] + [(r[0], "ORG") for r in table(spark, sf_dir, "nation", "n_name").orderBy("n_name").collect()]
    df = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lower("c_name"), F.lit(" in "), "n_name").alias("text"))
    out = df.select("c_custkey", F.explode(D.dictionary_candidates(F.col("text"), names_)).alias("c"))
    return out.select("c_custkey", "c.category", F.col("c.start").cast("bigint").alias("start"), F.col("c.value").alias("value"))


def _term_sql(term: str, category: str, word: bool) -> str:
    low = term.lower()
    edge = f"AND NOT regexp_matches(text[i - 1:i - 1], '[A-Za-z0-9_]') AND NOT regexp_matches(text[i + {len(term)}:i + {len(term)}], '[A-Za-z0-9_]')" if word else ""
    return (f"""SELECT p_partkey, '{category}' AS category, i - 1 AS "start", i - 1 + {len(term)} AS "end", text[i:i + {len(term)} - 1] AS value, {'true' if DEFAULTS[category] else 'false'} AS selected """
            f"FROM (SELECT p_partkey, text, unnest(generate_series(1, len(text))) AS i FROM t) WHERE lower(text[i:i + {len(term)} - 1]) = '{low}' {edge}")


_DICTIONARY_SQL = ("WITH t AS (SELECT p_partkey, p_name || ' RING ringed, nation_1 nation_12 ' || p_brand AS text FROM part) "
                   + " UNION ALL ".join([_term_sql("ring", "PROJECT", True), _term_sql("small ring", "SYSTEM", False), _term_sql("NATION_1", "ORG", True), _term_sql("Brand#2", "CUSTOMER", False)]))

# Longest term first, then priority: (text, terms, values found).
LONGEST = [
    ("username user Portal Upgrade", [("user", "FIELD_NAME"), ("Portal", "SYSTEM"), ("Portal Upgrade", "PROJECT")], "user|Portal Upgrade"),
    ("PORTAL portal_x 周明明", [("portal", "system"), ("周明", "PERSON"), ("周明明", "CUSTOMER")], "PORTAL|周明"),
    ("a.b a+b aXb", [("a.b", "PROJECT"), ("a+b", "PROJECT")], "a.b|a+b"),
]


def dictionary_longest(spark, sf_dir):
    parts = [D.detect(frame(spark, [(i, t)], "id bigint, text string"), dictionary=terms, defaults={"SYSTEM": True}) for i, (t, terms, _) in enumerate(LONGEST)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", F.array_join(F.transform("findings", lambda f: f["value"]), "|").alias("found"))


def category_defaults(spark, sf_dir):
    names = [*CATEGORIES, "SOMETHING"]
    df = frame(spark, [(c,) for c in names], "category string")
    over = {"PERSON": False, "SYSTEM": True}
    c = F.col("category")
    return df.select("category", risk(c).alias("risk"), priority(c).cast("bigint").alias("priority"), known(c).alias("known"), default_selected(c).alias("selected"), default_selected(c, over).alias("selected_by_user"))


_DEFAULT_ROWS = [(c, v[0], v[1], True, v[2], {"PERSON": False, "SYSTEM": True}.get(c, v[2])) for c, v in CATEGORIES.items()] + [("SOMETHING", "low", 7, False, False, False)]


def mapping_asof_ttl(spark, sf_dir):
    """Purchases make mappings and errors clear them; clicks ask for what is live."""
    ev = table(spark, sf_dir, "events").withColumn("payload", F.when(F.col("event_type") == "purchase", F.col("props")))
    makes = ev.where("event_type in ('purchase', 'error')").select("user_id", "ts", "event_id", "payload")
    asks = ev.where("event_type = 'click'").select("user_id", "ts", "event_id")
    out = recovery.live_mapping(asks, makes, "user_id", "ts", "event_id", "payload", ttl=36_000)
    return out.select("user_id", "event_id", "mapping_id")


_ASOF_SQL = """
WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), m AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IN ('purchase', 'error')),
j AS (SELECT a.user_id, a.event_id, a.ts, m.event_id AS mid, m.ts AS mts, m.event_type AS kind FROM a ASOF LEFT JOIN m ON a.user_id = m.user_id AND a.ts >= m.ts)
SELECT user_id, event_id, CASE WHEN kind = 'purchase' AND ts < mts + INTERVAL 36000 SECONDS THEN mid END AS mapping_id FROM j
"""


def latest_generation(spark, sf_dir):
    return recovery.newest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_ALL = FINDINGS + f"""SELECT doc_id, category || ':' || "start" || ':' || "end" AS finding_id, category, "start", "end", value, 'rule' AS source, true AS selected, {_RISK} AS risk FROM f"""
PLANS = {
    "detect_documents": (detect_documents, _ALL),
    "detect_category_counts": (detect_category_counts, FINDINGS + "SELECT category, count(*) AS n FROM f GROUP BY category"),
    "detect_lang_rollup": (detect_lang_rollup, FINDINGS + f"SELECT lang, category, count(*) AS n, count(*) FILTER ({_RISK} = 'high') AS high_risk FROM f JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, category)"),
    "occurrence_groups": (occurrence_groups, FINDINGS + """SELECT doc_id, category, lower(value) AS folded, arg_min(value, "start") AS value, count(*) AS n, arg_min(value, "start") || CASE WHEN count(*) > 1 THEN ' ×' || count(*) ELSE '' END AS label FROM f GROUP BY doc_id, category, lower(value)"""),
    "mask_documents": (mask_documents, _NUMBERED + f"SELECT doc_id, masked, (SELECT count(*) FROM f WHERE f.doc_id = m.doc_id) AS n_findings FROM {_assembled('r.replacement')} m"),
    "mask_findings": (mask_findings, _NUMBERED + """SELECT doc_id, category, "start", "end", value, replacement FROM r"""),
    "mask_high_risk_only": (mask_high_risk_only, _NUMBERED + f"SELECT doc_id, masked FROM {_assembled(f'CASE WHEN ({_RISK}) = {chr(39)}high{chr(39)} THEN r.replacement ELSE r.value END')}"),
    "mask_group_toggle": (mask_group_toggle, _NUMBERED.replace("FROM f GROUP BY ALL", "FROM f WHERE NOT (category = 'EMAIL' AND lower(value) LIKE '%7.example.com') GROUP BY ALL").replace("FROM f JOIN n ON", "FROM f LEFT JOIN n ON") + f"SELECT doc_id, masked FROM {_assembled('coalesce(r.replacement, r.value)')}"),
    "unmasked_high_risk": (unmasked_high_risk, FINDINGS + "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM f WHERE category = 'EMAIL') THEN 'EMAIL' ELSE '' END AS categories FROM documents"),
    "mapping_build": (mapping_build, _NUMBERED + """SELECT doc_id, replacement AS placeholder, arg_max(value, "start") AS original FROM r GROUP BY doc_id, replacement"""),
    "restore_documents": (restore_documents, FINDINGS + "SELECT doc_id, text, (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id) AS restored_count, CAST(0 AS BIGINT) AS unknown_count FROM documents d"),
    "restore_joined": (restore_joined, FINDINGS + "SELECT doc_id, text || ' <PHONE_99> <MADE_1>' AS restored, (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id) AS restored_count, CAST(1 AS BIGINT) AS unknown_count FROM documents d"),
    "restore_unknown": (restore_unknown, values_sql([(i, t, a, b) for i, (_, _, t, a, b) in enumerate(RESTORE)], "id BIGINT, text VARCHAR, restored_count BIGINT, unknown_count BIGINT")),
    "roundtrip_exact": (roundtrip_exact, "SELECT count(*) AS documents, count(*) AS exact FROM documents"),
    "reserved_numbering": (reserved_numbering, values_sql([(i, m) for i, (_, m) in enumerate(NUMBERING)], "id BIGINT, masked VARCHAR")),
    "resolve_overlaps": (resolve_overlaps, _RESOLVE_SQL),
    "text_guard": (text_guard, r"SELECT CASE WHEN text IS NULL OR regexp_full_match(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]*') THEN 'blank' WHEN len(text) > 100000 THEN 'too_long' ELSE 'ok' END AS status, count(*) AS n, CAST(sum(len(text)) AS BIGINT) AS chars FROM documents GROUP BY 1"),
    "dictionary_match": (dictionary_match, _DICTIONARY_SQL),
    "dictionary_large": (dictionary_large, """SELECT c_custkey, 'ORG' AS category, CAST(len(c_name) + 4 AS BIGINT) AS "start", n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 'CUSTOMER', 0, lower(c_name) FROM customer"""),
    "dictionary_longest": (dictionary_longest, values_sql([(i, f) for i, (_, _, f) in enumerate(LONGEST)], "id BIGINT, found VARCHAR")),
    "category_defaults": (category_defaults, values_sql(_DEFAULT_ROWS, "category VARCHAR, risk VARCHAR, priority BIGINT, known BOOLEAN, selected BOOLEAN, selected_by_user BOOLEAN")),
    "mapping_asof_ttl": (mapping_asof_ttl, _ASOF_SQL),
    "latest_generation": (latest_generation, "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"),
}

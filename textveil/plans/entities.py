"""Entities, names, chunks and tokens over literal cases and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textveil.functions.catalog import none_of
from textveil.operators import chunking, entities, names, recognise, tokenize
from textveil.operators.detect import detect, exploded
from textveil.operators.names import ENTITY
from textveil.plans.common import frame, table, values_sql

ENTITY_ROW = "id bigint, text string, entities " + ENTITY
SPAN_COLUMNS = 'id BIGINT, category VARCHAR, "start" BIGINT, "end" BIGINT, value VARCHAR'


def _spans(df, column: str, value: str = "value"):
    rows = df.select("id", F.explode(column).alias("c"))
    return rows.select("id", "c.category", F.col("c.start").cast("bigint").alias("start"), F.col("c.end").cast("bigint").alias("end"), F.col(f"c.{value}").alias("value"))


def _entity(category, start, end, text, confidence=0.9, model="m"):
    return (category, start, end, text, confidence, model)


# (text, entities, (category, start, end, value) that are kept)
VALID = [
    ("秦岚来电", [_entity("PERSON", 0, 2, "秦岚")], [("PERSON", 0, 2, "秦岚")]),
    ("秦岚来电", [_entity("person", 0, 2, "秦岚")], [("PERSON", 0, 2, "秦岚")]),
    ("秦岚来电", [_entity("TOWN", 0, 2, "秦岚"), _entity("PERSON", 1, 7, "岚来电"), _entity("PERSON", -2, 2, "秦岚"), _entity("PERSON", 0, 2, "岚秦"), _entity("PERSON", 3, 3, "")], []),
    ("秦岚来电", [_entity("PERSON", 0, 2, "秦岚", c) for c in (float("nan"), float("inf"), -0.2, 1.5, None)], []),
    ("清理缓存", [_entity("PERSON", 2, 4, "缓存")], []),
    ("审核人：缓存", [_entity("PERSON", 4, 6, "缓存")], [("PERSON", 4, 6, "缓存")]),
    ("海棠科技有限公司", [_entity("PERSON", 0, 8, "海棠科技有限公司"), _entity("ORG", 0, 8, "海棠科技有限公司")], [("ORG", 0, 8, "海棠科技有限公司")]),
    ("😀秦岚", [_entity("PERSON", 1, 3, "秦岚", 0.0)], [("PERSON", 1, 3, "秦岚")]),
]
THRESHOLDS = {"m": {"PERSON": 0.8}, "other": {"ORG": 0.5}}
THRESHOLD = [("m", "PERSON", 0.79, False), ("m", "PERSON", 0.8, True), ("m", "ORG", 0.01, True), ("other", "ORG", 0.49, False), ("other", "PERSON", 0.0, True), ("unknown", "ORG", 0.0, True), (None, "ORG", 0.2, True)]
SPLIT = [("秦岚 秦岚岚", [_entity("PERSON", 0, 6, "秦岚 秦岚岚")], [("PERSON", 0, 2, "秦岚"), ("PERSON", 3, 6, "秦岚岚")]), ("a b", [_entity("ORG", 0, 3, "a b")], [("ORG", 0, 3, "a b")]), ("y秦　岚", [_entity("PERSON", 1, 4, "秦　岚")], [("PERSON", 1, 2, "秦"), ("PERSON", 3, 4, "岚")])]


def _spread(text: str, given: list[tuple], added: list[tuple]) -> tuple:
    """A case of spreading: entities and what joins them, as (category, value, which occurrence)."""
    def place(category, value, n):
        at = -1
        for _ in range(n):
            at = text.index(value, at + 1)
        return category, at, at + len(value), value

    return text, [_entity(*place(*g)) for g in given], [place(*g) for g in given + added]


# (text, entities, all findings)
SPREAD = [
    _spread("秦岚写完初稿，校对也归秦岚，明早问秦岚。", [("PERSON", "秦岚", 1)], [("PERSON", "秦岚", 2), ("PERSON", "秦岚", 3)]),
    _spread("秦岚岚替秦岚值班", [("PERSON", "秦岚", 2)], []),
    _spread("全国高校江南理工学院（东区）分会邀请江南理工学院参加", [("ORG", "江南理工学院", 2)], []),
    _spread("秦岚写完初稿。秦岚贸易有限公司。", [("PERSON", "秦岚", 1)], []),
    _spread("司空远山找到司空远。", [("PERSON", "司空远山", 1), ("PERSON", "司空远", 2)], []),
    _spread("秦岚秦岚电子 秦岚。", [("PERSON", "秦岚", 1), ("PERSON", "秦岚秦岚电子", 1)], []),
    _spread("B[2] 与B[2] 在B[2]", [("ORG", "B[2]", 1)], [("ORG", "B[2]", 2), ("ORG", "B[2]", 3)]),
]
HE = [("何立新处理退款", [("PERSON", 0, 3, "何立新")]), ("为何如此安排。何人签字。何以服众。", []), ("请何安国联系", []), ("😀何大年确认了，何事提交", [("PERSON", 1, 4, "何大年")])]

# Names made of a customer's number, in sentences that hang on it: both engines build them from these lists.
FAMILY, GIVEN = ["王", "李", "张", "刘", "陈", "杨", "赵", "吴", "周", "徐"], ["伟", "芳", "敏", "静", "磊", "勇", "杰", "明远", "清禾", "思涵"]
# (before, after): what stands around a name; the last two say nothing about it
SETTINGS = [("审核人：", "。合同已归档。"), ("", "昨天提交了表格。"), ("请联系", "，谢谢。"), ("owner=", " done"), ("", "的合同在这里。"), ("走廊里挂着", "画像")]
SURE = 4
NO_NAMES = ["周末要加班", "高可用方案上线", "沈阳下雪了", "白名单已更新", "何时开门", "何以见得", "林数据库重启", "金数据导出", "高性能模式", "于今日生效"]


def _array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _name(key: str) -> str:
    return f"concat(element_at({_array(FAMILY)}, CAST(({key}) % 10 + 1 AS INT)), element_at({_array(GIVEN)}, CAST(({key}) div 10 % 10 + 1 AS INT)))"


def _name_sql(key: str) -> str:
    return f"[{', '.join(repr(x) for x in FAMILY)}][({key}) % 10 + 1] || [{', '.join(repr(x) for x in GIVEN)}][({key}) // 10 % 10 + 1]"


def _setting(column: int) -> str:
    return f"element_at({_array(x[column] for x in SETTINGS)}, CAST(c_custkey div 100 % {len(SETTINGS)} + 1 AS INT))"


LABEL = [("人名", "PERSON"), ("组织机构", "ORG"), ("组织", "ORG"), ("PER", "PERSON"), ("org", "ORG"), ("B-name", "PERSON"), ("I-company", "ORG"), ("government", "ORG"), ("B-Organization", "ORG"), ("address", None), ("", None)]
TAGGED = [
    ("秦岚在海棠科技见秦岚", [("秦岚", "PER"), ("在", "p"), ("海棠科技", "ORG"), ("秦岚", "PER")], [("PERSON", 0, 2, "秦岚"), ("ORG", 3, 7, "海棠科技"), ("PERSON", 8, 10, "秦岚")]),
    ("a b a", [("b", "x"), ("a", "PER"), ("", "PER"), ("zz", "PER"), ("a", "PER")], [("PERSON", 4, 5, "a"), ("PERSON", 0, 1, "a")]),
]
PLACE = [
    # chunk, chunks, chunk_start, chunk_end, label, start, end, score -> kept?
    (0, 2, 0, 10, "B-name", 0, 2, 0.9), (0, 2, 0, 10, "company", 8, 10, 0.8), (1, 2, 6, 20, "company", 0, 4, 0.7), (1, 2, 6, 20, "company", 2, 4, 0.6), (1, 2, 6, 20, "I-name", 12, 14, 0.5), (1, 2, 6, 20, "address", 5, 6, 0.9),
]
PLACE_TEXT = "abcdefghijklmnopqrst"


def _entity_frame(spark, cases):
    return frame(spark, [(i, t, e) for i, (t, e, *_) in enumerate(cases)], ENTITY_ROW)


def _span_rows(cases, at: int = -1):
    return [(i, *s) for i, case in enumerate(cases) for s in case[at]]


def entity_validate(spark, sf_dir):
    good = F.filter("entities", lambda e: entities.valid(F.col("text"), e))
    return _spans(_entity_frame(spark, VALID).withColumn("c", F.transform(good, lambda e: e.withField("category", F.upper(e["category"])))), "c", "text")


def entity_threshold(spark, sf_dir):
    df = frame(spark, [(i, m, c, v) for i, (m, c, v, _) in enumerate(THRESHOLD)], "id bigint, model string, category string, confidence double")
    return df.select("id", (F.col("confidence") >= entities.threshold(F.col("model"), F.col("category"), THRESHOLDS)).alias("kept"))


def entity_split_ws(spark, sf_dir):
    return _spans(_entity_frame(spark, SPLIT).withColumn("c", entities.split_persons(F.col("entities"))), "c", "text")


def entity_expand(spark, sf_dir):
    """The literal cases, and a customer's name in a sentence of its own: spread to the second place, not to a company's name."""
    name = F.expr(_name("c_custkey"))
    made = table(spark, sf_dir, "customer", "c_custkey").select((F.col("c_custkey") + 1000).alias("id"), F.concat(name, F.lit("到场，记录人"), name, F.lit("。"), name, F.lit("科技有限公司")).alias("text"), name.alias("n"))
    entity = F.struct(F.lit("PERSON").alias("category"), F.lit(0).alias("start"), F.length("n").alias("end"), F.col("n").alias("text"), F.lit(0.9).alias("confidence"), F.lit("m").alias("model"))
    made = made.select("id", "text", F.array(entity).alias("entities"))
    return _spans(_entity_frame(spark, SPREAD).unionByName(made).withColumn("c", entities.to_findings(F.col("text"), F.col("entities"))), "c")


def entity_dedup_best(spark, sf_dir):
    """Of equal spans the most confident model's; confidences and models follow from order lines."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", F.lit("PERSON").alias("category"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 2).alias("end"), F.lit("x").alias("text"),
                     F.when(F.col("l_partkey") % 5 > 0, F.col("l_partkey") % 5 / 10).alias("confidence"), F.col("l_suppkey").cast("string").alias("model"))
    return entities.best_per_span(rows, ["l_orderkey"]).select("l_orderkey", "start", "confidence", "model")


def entity_shadow(spark, sf_dir):
    """Person spans that a longer one of the same order covers."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("l_suppkey % 20").alias("s"), F.expr("l_suppkey % 20 + 1 + l_partkey % 6").alias("e"))
    spans = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("PERSON").alias("category"), F.col("s").alias("start"), F.col("e").alias("end"), "l_linenumber")).alias("f"))
    one = spans.select("l_orderkey", "f", F.explode("f").alias("x"))
    return one.select("l_orderkey", F.col("x.l_linenumber").alias("l_linenumber"), F.col("x.start").alias("start"), F.col("x.end").alias("end"), entities.shadowed(F.col("x.category"), F.col("x.start"), F.col("x.end"), F.col("f")).alias("shadowed"))


def names_he(spark, sf_dir):
    df = frame(spark, [(i, t) for i, (t, _) in enumerate(HE)], "id bigint, text string")
    return _spans(df.withColumn("c", entities.to_findings(F.col("text"), none_of(ENTITY))), "c")


def _named(df, *keys):
    out = df.withColumn("e", names.names_udf()(F.col("text")))
    return out.select(*keys, F.array_join(F.transform("e", lambda e: e["text"]), "|").alias("names"))


def names_basic(spark, sf_dir):
    """A customer's name in one of SETTINGS."""
    df = table(spark, sf_dir, "customer", "c_custkey").withColumn("text", F.expr(f"concat({_setting(0)}, {_name('c_custkey')}, {_setting(1)})"))
    return _named(df, "c_custkey")


def names_pairs(spark, sf_dir):
    """Two names that a connector joins, which are found by each other."""
    df = table(spark, sf_dir, "customer", "c_custkey").withColumn("text", F.expr(f"concat({_name('c_custkey')}, '及', {_name('c_custkey * 7 + 3')}, '进行核对。')"))
    return _named(df, "c_custkey")


def names_blocked(spark, sf_dir):
    """What looks like a name and is none, in texts made of parts."""
    df = table(spark, sf_dir, "part", "p_partkey").withColumn("text", F.expr(f"concat(element_at({_array(NO_NAMES)}, CAST(p_partkey % {len(NO_NAMES)} + 1 AS INT)), '，编号', p_partkey, '。')"))
    return _named(df, "p_partkey")


def names_conversations(spark, sf_dir):
    """The detector over conversations with a name put before every second turn."""
    name = F.expr(_name("conv_id"))
    df = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("联系人："), name, F.lit("。"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    out = df.withColumn("e", names.names_udf()(F.col("text")))
    return out.groupBy("turn").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size("e")).cast("bigint").alias("names"))


def names_detect(spark, sf_dir):
    """Names within full detection, beside a rule's finding."""
    df = table(spark, sf_dir, "customer", "c_custkey").withColumn("text", F.expr(f"concat('负责人：', {_name('c_custkey')}, '，电话138', lpad(CAST(c_custkey AS STRING), 8, '0'), '。')"))
    return exploded(detect(df, names=True), ["c_custkey"]).select("c_custkey", "category", "start", "end", "value", "source")


def label_normalise(spark, sf_dir):
    df = frame(spark, [(x,) for x, _ in LABEL], "label string")
    return df.select("label", entities.label_category(F.col("label")).alias("category"))


def tagged_locate(spark, sf_dir):
    df = frame(spark, [(i, t, tags) for i, (t, tags, _) in enumerate(TAGGED)], "id bigint, text string, tags array<struct<value:string,label:string>>")
    return _spans(df.withColumn("c", entities.locate_tagged(F.col("text"), F.col("tags"))), "c", "text")


def chunk_chars(spark, sf_dir):
    df = table(spark, sf_dir, "documents", "doc_id", "text")
    out = chunking.char_chunks(df, "人名")
    return out.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.length("chunk_text").cast("bigint").alias("chars"))


def chunk_alphabet(spark, sf_dir):
    df = frame(spark, [(0, "abcdefghijklmnopqrstuvwxyz"), (1, ""), (2, None)], "id bigint, text string")
    return chunking.char_chunks(df, "人名", max_length=12, overlap=3).select("id", "chunk_text", F.col("start").cast("bigint").alias("start"))


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def chunk_tokens(spark, sf_dir):
    """Words as tokens."""
    df = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).alias("n"))
    df = df.withColumn("offsets", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((i * 3).alias("start"), (i * 3 + 2).alias("end"))))
    out = chunking.token_chunks(df, "offsets")
    return out.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))


def chunk_boundary_filter(spark, sf_dir):
    df = frame(spark, [(i, PLACE_TEXT, *r) for i, r in enumerate(PLACE)], "id bigint, text string, chunk int, chunks int, chunk_start int, chunk_end int, label string, start int, end int, score double")
    out = chunking.place(df)
    return out.select("id", "category", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("text").alias("value"))


VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *"abcdefghijklmnopqrstuvwxyz0123456789#_", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz0123456789_")]


def wordpiece(spark, sf_dir):
    """Part names in pieces of one character; marks are words of their own."""
    vocab = {t: i for i, t in enumerate(VOCAB)}
    df = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", F.concat_ws(" ", F.upper("p_name"), "p_brand").alias("text")).withColumn("p", tokenize.tokens_udf(vocab)(F.col("text")))
    return df.select("p_partkey", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["piece"], x["start"].cast("string"), x["end"].cast("string"))), "|").alias("pieces"))


def span_decode(spark, sf_dir):
    """Prompt of one token, then five of text: starts at 3 and 4, ends at 4 and 6; two starts before one end, so the later one wins."""
    offsets = [[0, 0], [0, 2], [0, 0], [0, 1], [1, 2], [2, 3], [3, 5], [5, 6], [0, 0]]
    rows = [(0, "abcdef", 100, offsets, [0.0, 0.0, 0.0, 0.9, 0.8, 0.0, 0.7, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0, 0.6, 0.0, 0.9, 0.0, 0.0]), (1, "abcdef", 0, offsets, [0.9] + [0.0] * 8, [0.0] * 9)]
    df = frame(spark, rows, "id bigint, text string, at int, o array<array<int>>, s array<double>, e array<double>")
    out = df.select("id", F.explode(tokenize.decode_udf()("text", "at", "o", "s", "e")).alias("d"))
    return out.select("id", F.col("d.start").cast("bigint").alias("start"), F.col("d.end").cast("bigint").alias("end"), F.col("d.text").alias("value"), F.round("d.score", 6).alias("score"))


def recogniser_degrades(spark, sf_dir):
    """A recogniser that can't be loaded gives no entities and says why; detection by rules goes on."""

    def broken():
        raise OSError("no model here")

    df = frame(spark, [(0, "秦岚 a@b.com")], "id bigint, text string")
    out = recognise.recognise(df, broken, "broken")
    return out.select("id", F.size("entities").cast("bigint").alias("entities"), "error")


PLANS = {
    "entity_validate": (entity_validate, values_sql(_span_rows(VALID), SPAN_COLUMNS)),
    "entity_threshold": (entity_threshold, values_sql([(i, k) for i, (*_, k) in enumerate(THRESHOLD)], "id BIGINT, kept BOOLEAN")),
    "entity_split_ws": (entity_split_ws, values_sql(_span_rows(SPLIT), SPAN_COLUMNS)),
    "entity_expand": (entity_expand, values_sql(_span_rows(SPREAD), SPAN_COLUMNS) + f""" UNION ALL SELECT c_custkey + 1000, 'PERSON', 0, len(n), n FROM (SELECT c_custkey, {_name_sql('c_custkey')} AS n FROM customer)
UNION ALL SELECT c_custkey + 1000, 'PERSON', len(n) + 6, 2 * len(n) + 6, n FROM (SELECT c_custkey, {_name_sql('c_custkey')} AS n FROM customer)"""),
    "entity_dedup_best": (entity_dedup_best, """SELECT l_orderkey, "start", confidence, model FROM (SELECT l_orderkey, l_linenumber AS "start", CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 5 / 10 END AS confidence, CAST(l_suppkey AS VARCHAR) AS model,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey % 5 DESC, CAST(l_suppkey AS VARCHAR)) AS n FROM lineitem) WHERE n = 1"""),
    "entity_shadow": (entity_shadow, """WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS s, l_suppkey % 20 + 1 + l_partkey % 6 AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, s AS "start", e AS "end", EXISTS (SELECT 1 FROM t o WHERE o.l_orderkey = t.l_orderkey AND o.s <= t.s AND t.e <= o.e AND o.e - o.s > t.e - t.s) AS shadowed FROM t"""),
    "names_he": (names_he, values_sql(_span_rows(HE), SPAN_COLUMNS)),
    "names_basic": (names_basic, f"SELECT c_custkey, CASE WHEN c_custkey // 100 % {len(SETTINGS)} < {SURE} THEN {_name_sql('c_custkey')} ELSE '' END AS names FROM customer"),
    "names_pairs": (names_pairs, f"SELECT c_custkey, {_name_sql('c_custkey')} || '|' || {_name_sql('c_custkey * 7 + 3')} AS names FROM customer"),
    "names_blocked": (names_blocked, "SELECT p_partkey, '' AS names FROM part"),
    "names_conversations": (names_conversations, "SELECT turn, count(*) AS texts, CAST(CASE WHEN turn % 2 = 0 THEN count(*) ELSE 0 END AS BIGINT) AS names FROM conversations GROUP BY turn"),
    "names_detect": (names_detect, f"""WITH c AS (SELECT c_custkey, {_name_sql('c_custkey')} AS n FROM customer)
SELECT c_custkey, 'PERSON' AS category, CAST(4 AS BIGINT) AS "start", CAST(4 + len(n) AS BIGINT) AS "end", n AS value, 'lightweight_person' AS source FROM c
UNION ALL SELECT c_custkey, 'PHONE', 7 + len(n), 18 + len(n), '138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 'rule' FROM c"""),
    "label_normalise": (label_normalise, values_sql(LABEL, "label VARCHAR, category VARCHAR")),
    "tagged_locate": (tagged_locate, values_sql(_span_rows(TAGGED), SPAN_COLUMNS)),
    "chunk_chars": (chunk_chars, """WITH d AS (SELECT doc_id, len(text) AS n FROM documents), w AS (SELECT doc_id, n, unnest(generate_series(0, greatest(0, CAST(ceil((n - 240) / 208.0) AS BIGINT)))) AS chunk FROM d)
SELECT doc_id, chunk, chunk * 208 AS "start", least(chunk * 208 + 240, n) AS "end", least(chunk * 208 + 240, n) - chunk * 208 AS chars FROM w"""),
    "chunk_alphabet": (chunk_alphabet, values_sql([(0, _ALPHABET[a : a + 7], a) for a in range(0, 21, 4)] + [(1, "", 0), (2, "", 0)], 'id BIGINT, chunk_text VARCHAR, "start" BIGINT')),
    "chunk_tokens": (chunk_tokens, r"""WITH d AS (SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '^ +| +$', '', 'g'), '\s+')) AS n FROM documents), w AS (SELECT doc_id, n, unnest(generate_series(0, greatest(0, CAST(ceil((n - 510) / 446.0) AS BIGINT)))) AS chunk FROM d)
SELECT doc_id, chunk, chunk * 446 * 3 AS "start", (least(chunk * 446 + 510, n) - 1) * 3 + 2 AS "end" FROM w"""),
    "chunk_boundary_filter": (chunk_boundary_filter, values_sql([(0, "PERSON", 0, 2, "ab"), (3, "ORG", 8, 10, "ij"), (4, "PERSON", 18, 20, "st")], SPAN_COLUMNS)),
    "wordpiece": (wordpiece, r"""WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_brand) AS x FROM part), c AS (SELECT p_partkey, x, unnest(generate_series(1, len(x))) AS i FROM t)
SELECT p_partkey, string_agg(CASE WHEN regexp_matches(x[i - 1:i - 1], '[a-z0-9]') AND regexp_matches(x[i:i], '[a-z0-9]') THEN '##' ELSE '' END || x[i:i] || ':' || (i - 1) || ':' || i, '|' ORDER BY i) AS pieces FROM c WHERE x[i:i] <> ' ' GROUP BY p_partkey"""),
    "span_decode": (span_decode, values_sql([(0, 101, 102, "b", 0.48), (0, 103, 105, "de", 0.63)], 'id BIGINT, "start" BIGINT, "end" BIGINT, value VARCHAR, score DOUBLE')),
    "recogniser_degrades": (recogniser_degrades, values_sql([(0, 0, "OSError: no model here")], "id BIGINT, entities BIGINT, error VARCHAR")),
}

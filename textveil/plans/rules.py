"""Each pattern rule over a table; rules whose values no table holds run on texts made from table columns, or on literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from textveil.functions.rules import BY_NAME
from textveil.plans.common import span_rows, spans_sql, table

LUHN = """(SELECT sum(CASE WHEN (len(value) - k) % 2 = 1 THEN CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END ELSE d END) % 10 = 0
  FROM (SELECT k, CAST(value[k] AS INT) AS d FROM (SELECT unnest(generate_series(1, len(value))) AS k)))"""


def on_table(rule: str, name: str, key: str, text: str = "text"):
    def query(spark, sf_dir):
        df = table(spark, sf_dir, name, key, text)
        return span_rows(df, BY_NAME[rule].spans(F.col(text)), key)

    return query


def on_made(rule: str, name: str, key: str, text: str):
    """On a text made by an expression that both engines read."""

    def query(spark, sf_dir):
        df = table(spark, sf_dir, name).select(key, F.expr(text).alias("text"))
        return span_rows(df, BY_NAME[rule].spans(F.col("text")), key)

    return query


def made(rule: str, name: str, key: str, text: str, pattern: str, lead: str = "", keep: str = "true"):
    """Query and oracle: matches of `pattern` whose text after `lead` is the value."""
    source = f"SELECT {key}, {text} AS text FROM {name}"
    sql = spans_sql(source, key, "text", pattern, keep)
    if lead:
        cut = "regexp_extract(value, '" + lead.replace("'", "''") + "')"
        # a quoted value ends before its closing quote
        sql = f"""SELECT {key}, "start" + len({cut}) AS "start", "start" + len({cut}) + len(v) AS "end", v AS value
FROM (SELECT *, regexp_replace(value[len({cut}) + 1:], '["''`]$', '') AS v FROM ({sql}))"""
    return on_made(rule, name, key, text), sql


DIGITS = "CAST(c_custkey AS STRING)"
PADDED = f"lpad({DIGITS}, 9, '0')"

PLANS = {
    "rule_email": (on_table("email", "documents", "doc_id"), spans_sql("SELECT doc_id, text FROM documents WHERE contains(text, '@')", "doc_id", "text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", r"regexp_full_match(value, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")),
    "rule_bank_card": (on_table("bank_card", "documents", "doc_id"), spans_sql("SELECT doc_id, text FROM documents", "doc_id", "text", "[0-9]+", f"len(value) BETWEEN 16 AND 19 AND {LUHN}")),
    "rule_ipv4": (on_table("ipv4", "documents", "doc_id"), spans_sql("SELECT doc_id, text FROM documents", "doc_id", "text", "[0-9.]+", r"regexp_full_match(value, '(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}')")),
    "rule_token": (on_table("token", "documents", "doc_id"),
                   spans_sql("SELECT doc_id, text FROM documents", "doc_id", "text", r'(?i)"?(?:access[_ ]?token|refresh_token|token)"?\s*[:=]\s*"[^"' + r"'`\r\n]*").replace('SELECT doc_id, "start", "start" + len(value) AS "end", value FROM placed WHERE true',
                             """SELECT doc_id, "start" + len(lead) AS "start", "start" + len(value) AS "end", value[len(lead) + 1:] AS value FROM (SELECT *, regexp_extract(value, '^[^=:]*[:=]\\s*"') AS lead FROM placed)""")),
    "rule_domain": (on_table("domain", "documents", "doc_id"),
                    spans_sql("SELECT doc_id, text FROM documents", "doc_id", "text", r"[A-Za-z0-9.-]*\.[A-Za-z0-9.-]*", r"regexp_full_match(value, '([A-Za-z0-9-]+\.){2,}(?i:com|net|org|cn|io|co|edu|gov|dev|ai)') AND NOT regexp_matches(value, '(^|\.)-|-\.|[A-Za-z0-9-]{64}')")),
    "rule_url": (on_table("url", "pages", "page_id", "url"), spans_sql("SELECT page_id, url FROM pages", "page_id", "url", r"""(?i)https?://[^\s'"<>，。；）】]+""")),
    "rule_db_credential": made("db_credential", "customer", "c_custkey", f"'db jdbc:mysql://10.0.0.1:3306/t' || {DIGITS} || '?user=a, or postgres://u:p@h/' || {DIGITS} || '。'", r"(?:jdbc:[a-z0-9]+|(?:mysql|postgres(?:ql)?|mssql)://)[^\s'\"<>，。；）】]+"),
    "rule_api_key": made("api_key", "customer", "c_custkey", f"'api_key = \"k' || {PADDED} || 'abcd\" and sk_' || {PADDED} || 'zzzz- api key: short'", r'(?i)api[_ -]?key"?\s*[:=]\s*"[A-Za-z0-9._~-]{12,}|sk_[A-Za-z0-9_]{12,}', r'(?i)^(?:api[_ -]?key"?\s*[:=]\s*"|)'),
    "rule_password": made("password", "customer", "c_custkey", f"'DB_PASSWORD=Pw' || {DIGITS} || '!, 密码为 ' || c_name || '；pwd: \"\" '", r'(?:PASSWORD=[^\s,;，；}\]）】]+|密码为\s*[^\s,;，；}\]）】]+|pwd:\s*")', r'^(?:PASSWORD=|密码为\s*|pwd:\s*")'),
    "rule_secret": made("secret", "customer", "c_custkey", f"'client_secret: ''s' || {DIGITS} || ''' secret=' || c_mktsegment || ';'", r"secret\s*[:=]\s*(?:'[^'\r\n]*|[^\s,;']+)", r"^secret\s*[:=]\s*'?"),
    "rule_id": made("id", "orders", "o_orderkey", "'orderId=' || CAST(o_orderkey AS STRING) || ' \"CUST_ID\": \"' || CAST(o_custkey AS STRING) || 'x\" valid=12345 gridId=abc'",
                    r'(?:orderId=[A-Za-z0-9_-]{3,}|"CUST_ID": "[A-Za-z0-9_-]{3,})', r'^(?:orderId=|"CUST_ID": ")'),
    "rule_id_card": made("id_card", "customer", "c_custkey", f"'身份证11010519' || {PADDED} || 'X，x1234567890123456789012 1101051949' || lpad({DIGITS}, 8, '1')", r"[0-9]+[Xx]?", "", r"regexp_full_match(value, '[0-9]{17}[0-9Xx]')"),
    "rule_phone": made("phone", "customer", "c_custkey", f"'call +86 139' || lpad({DIGITS}, 8, '0') || ' or 138' || lpad({DIGITS}, 8, '7') || '9 or 12345678901'", r"(?:\+86[- ]?)?[0-9]+", "", r"regexp_full_match(value, '(\+86[- ]?)?1[3-9][0-9]{9}')"),
    "rule_ipv6": made("ipv6", "customer", "c_custkey", "'via fd00:0:0:1::' || lower(hex(c_custkey % 65536)) || ' or 12:30 ab::cd::' || lower(hex(c_custkey % 65536)) || ' bad 1:2:3'", "[0-9A-Fa-f:]{2,}", "", "regexp_full_match(value, 'fd00:0:0:1::[0-9a-f]{1,4}')"),
}

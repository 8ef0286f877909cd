"""WARC derivatives: each response record becomes a metadata record and a plain-text conversion record, linked to it.

Both keep the response's target, date and digests; WARC-Refers-To holds its record id, and its HTTP status and headers are
carried into the metadata block. Ids of derived records are name-based on the response's id and the kind, so reruns agree; those of
responses made from a table are based on id, address, date and page, so that two captures of one address differ. Rows equal in
all of these get equal ids. Markup is turned into text by a fixed list of regular expressions (STEPS). All of it is per record, so
nothing is shuffled.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textveil.functions.spans import let
from textveil.llm.common import fresh, named, table, task

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"  # of records built from tables that hold no date

# Markup to text, in this order.
STEPS = (
    (r"(?is)<(?:!--.*?-->|script[^>]*>.*?</script[^>]*>|style[^>]*>.*?</style[^>]*>|noscript[^>]*>.*?</noscript[^>]*>|template[^>]*>.*?</template[^>]*>)", " "),
    (r"[\x00-\x1F]+", " "),
    (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[ /][^>]*)?>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", ""),
)
TIDY = ((r"\xA0", " "), (r" {2,}", " "), (r" ?\n[ \n]*", "\n"))
# The named characters met most; all others are looked up in the standard's own table.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&pound;", "£"), ("&amp;", "&"),
)


def entities() -> dict[str, str]:
    """Name -> character for all names of HTML that end in a semicolon, without it; the blank that doesn't break is a blank."""
    from html.entities import html5

    return {name[:-1]: char for name, char in html5.items() if name.endswith(";")} | {name[1:-1]: char for name, char in ENTITIES}


TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANG = r'(?i)<html[^>]*[ ]lang="([^"]*)"'
LINK = r"(?i)<a [^>]*href="


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def unescape(text: Column) -> Column:
    """Numeric (decimal and hexadecimal) and named character references that end in a semicolon; numbers that are no character and names
    that aren't HTML's stay. One pass over what stands after each ampersand, so that what a reference gives isn't read as one."""
    usual = F.create_map(*[F.lit(x) for name, char in ENTITIES for x in (name[1:-1], char)])
    known = entities()
    every = F.from_json(F.lit(json.dumps(known, ensure_ascii=True)), "map<string,string>")

    def part(p, i):
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]{1,31});", 1)
        code = F.coalesce(F.regexp_extract(p, r"^#([0-9]{1,7});", 1).try_cast("int"), F.conv(F.nullif(F.regexp_extract(p, r"^#[xX]([0-9A-Fa-f]{1,6});", 1), F.lit("")), 16, 10).try_cast("int"))
        ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        after = F.substring(p, F.locate(";", p) + 1, F.length(p))
        named_ = F.coalesce(F.try_element_at(usual, name), F.when(name != "", F.try_element_at(every, name)))
        read = F.coalesce(F.when(p.startswith("#"), F.when(ok, _character(code))).otherwise(named_), F.lit(""))
        return F.when(i == 0, p).when(p.startswith("amp;"), F.concat(F.lit("&"), F.substring(p, 5, F.length(p)))).otherwise(
            let(read, lambda r: F.when(r != "", F.concat(r, after)).otherwise(F.concat(F.lit("&"), p))))

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&", -1), part), "")).otherwise(text)


def with_plain_text(df: DataFrame, html: str, name: str) -> DataFrame:
    """df with the text of markup: a line per block, without comments, scripts and styles. In steps, as one step's result is used
    more than once by the next and shouldn't be computed again."""
    text = F.col(html)
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, by)
    df = df.withColumn(name, text).withColumn(name, unescape(F.col(name)))
    text = F.col(name)
    for pattern, by in TIDY:
        text = F.regexp_replace(text, pattern, by)
    return df.withColumn(name, F.trim(text, F.lit(" \n")))


def urn(text: Column) -> Column:
    """A record id from a text's MD5."""
    h = F.md5(text)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages: (page_id, record_id, target_uri, warc_date, http_headers, payload, payload_digest, block_digest).

    Null addresses and pages count as empty; pages of any length are taken whole. Repeated rows give records with equal ids. An empty
    table gives no rows; other columns are ignored.
    """
    url, html = F.coalesce(named(url_col), F.lit("")), F.coalesce(named(html_col), F.lit(""))
    df = pages.select(named(id_col).alias("page_id"), url.alias("target_uri"), html.alias("payload"))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF))
    df = df.withColumns({"warc_date": F.lit(DATE), "http_headers": headers, "payload_digest": sha256(F.col("payload")), "block_digest": sha256(F.concat(headers, F.lit(CRLF), "payload"))})
    return df.withColumn("record_id", urn(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "target_uri", "warc_date", "payload_digest"))).select(
        "page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest", "block_digest")


def derive(records: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two rows per response: `keep`, warc_type, record_id, refers_to, target_uri, warc_date, content_type, content_length,
    block_digest, source_payload_digest, headers and block. Works on the columns that `responses` gives; repeated rows give rows each,
    with equal ids; an empty table gives no rows, and other columns are ignored."""
    title_, text_ = fresh(records.columns, "plain_title", "plain_text")
    records = records.withColumn(title_, F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[\x00-\x20]+", " "))
    records = with_plain_text(records, "payload", text_)
    title = F.trim(unescape(F.col(title_)))
    fields = [("title", title), ("html-lang", F.regexp_extract("payload", LANG, 1)), ("outlinks", F.regexp_count("payload", F.lit(LINK)).cast("string")),
              ("http-status", F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]+)", 1)), ("source-block-digest", F.col("block_digest"))]
    # the source's header lines follow, each marked as such
    lines = F.regexp_replace(F.regexp_replace(F.col("http_headers"), r"^[^\r\n]*\r\n", ""), r"([^\r\n]+)\r\n", "source-$1\r\n")
    about = F.concat(*[x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit(CRLF))], lines)

    def row(kind, content_type, block):
        return F.struct(F.lit(kind).alias("warc_type"), F.lit(content_type).alias("content_type"), block.alias("block"))

    both = records.select(*[named(c) for c in keep], "record_id", "target_uri", "warc_date", "payload_digest",
                          F.explode(F.array(row("metadata", "application/warc-fields", about), row("conversion", "text/plain; charset=utf-8", F.col(text_)))).alias("d"))
    out = both.select(*[named(c) for c in keep], F.col("d.warc_type"), urn(F.concat_ws("|", "d.warc_type", "record_id")).alias("id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
                      F.col("d.content_type"), F.octet_length("d.block").cast("long").alias("content_length"), sha256(F.col("d.block")).alias("block_digest"),
                      F.col("payload_digest").alias("source_payload_digest"), F.col("d.block"))
    head = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"),
            ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    headers = F.concat(F.lit(f"WARC/1.1{CRLF}"), *[x for name, c in head for x in (F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF))])
    return out.withColumn("headers", headers).withColumnRenamed("id", "record_id")


def write(records: DataFrame, path: str) -> None:
    """Write derived records as WARC files: header, blank line, block, and two line ends after each."""
    records.select(F.concat("headers", F.lit(CRLF), "block").alias("value")).write.option("lineSep", CRLF * 2).text(path)


#: What stands between two records, with the start of the second.
BETWEEN = "\r\n\r\nWARC/1."


def records_of(pieces):
    """(headers, block) of records from the pieces that BETWEEN cuts a file into, in order; one that holds BETWEEN itself is put together
    again by its length. Pieces that aren't a record's start are passed over."""
    held = None
    for piece in pieces:
        piece = piece[len("WARC/1.") :] if piece.startswith(b"WARC/1.") else piece  # a file's first
        if held is None:
            end = piece.find(b"\r\n\r\n")
            head = piece if end < 0 else piece[:end]
            if not re.match(rb"[0-9]\r\n", head):
                continue
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
            n, held = int(headers.get("content-length") or 0), [b"" if end < 0 else piece[end + 4 :]]
        else:
            held.append(piece)
        if sum(map(len, held)) + len(BETWEEN) * (len(held) - 1) >= n:
            yield headers, BETWEEN.encode().join(held)[:n]
            held = None


def read_responses(spark, path: str) -> DataFrame:
    """Response records of WARC files, plain or gzip, in the columns of `responses` (page_id null); digests are the file's own where it has them.

    Files are read as a stream of records by Spark's reader, by any path it can open; plain ones are cut into splits. A record has to fit in
    memory, a file hasn't.
    """
    pieces = spark.read.option("lineSep", BETWEEN).text(path).select(F.col("value").cast("binary"))
    arrow = [("page_id", "long"), *((c, "string") for c in ("record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest", "block_digest"))]

    @task
    def run(batches):
        import hashlib

        import pyarrow as pa

        schema = pa.schema([(c, pa.int64() if t == "long" else pa.string()) for c, t in arrow])
        digest = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
        rows, size = [], 0
        for h, block in records_of(x.as_py() for batch in batches for x in batch.column(0)):
            if h.get("warc-type") == "response":
                head, _, body = block.partition(b"\r\n\r\n")
                rows.append({"page_id": None, "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri", ""), "warc_date": h.get("warc-date", DATE), "http_headers": head.decode("utf-8", "replace") + CRLF,
                             "payload": body.decode("utf-8", "replace"), "payload_digest": h.get("warc-payload-digest", digest(body)), "block_digest": h.get("warc-block-digest", digest(block))})
                size += len(block)
            if len(rows) >= 500 or size > 16 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pieces.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in arrow))


def query(spark, sf_dir: str) -> DataFrame:
    return derive(responses(table(spark, sf_dir, "pages")))


def _oracle() -> str:
    """SQL of the query, written without STEPS and `unescape`: removed parts one kind after the other, block tags by a list of
    names, and references found and replaced one name at a time."""
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def plain(x: str) -> str:
        for tag in ("script", "style", "noscript", "template"):
            x = f"regexp_replace({x}, '<{tag}[^>]*>.*?</{tag}[^>]*>', ' ', 'gis')"
        x = f"regexp_replace(regexp_replace({x}, '<!--.*?-->', ' ', 'gs'), '[[:cntrl:]]+', ' ', 'g')"
        blocks = "address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul"
        x = f"regexp_replace({x}, '</?({'|'.join(blocks.split())})([ /][^>]*)?>', chr(10), 'gi')"
        return f"regexp_replace({x}, '<[a-z/!?][^>]*>', '', 'gi')"

    def unescaped(x: str) -> str:
        known = entities()
        names = "map([" + ", ".join(lit(n) for n in known) + "], [" + ", ".join(" || ".join(f"chr({ord(c)})" for c in char) for char in known.values()) + "])"
        # a reference is what an ampersand and the next semicolon hold; the pieces between references stay
        ref = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
        number = "CASE WHEN r[3] IN ('x', 'X') THEN TRY_CAST('0x' || r[4:-2] AS INT) WHEN r[2] = '#' THEN TRY_CAST(r[3:-2] AS INT) END"
        value = f"""coalesce(CASE WHEN r[2] = '#' THEN CASE WHEN ({number} BETWEEN 1 AND 55295) OR ({number} BETWEEN 57344 AND 1114111) THEN chr({number}) END ELSE {names}[r[2:-2]] END, r)"""
        return f"""list_aggregate(list_transform(list_zip(regexp_split_to_array({x}, '{ref}'), list_concat(regexp_extract_all({x}, '{ref}'), [''])), lambda z: z[1] || list_transform([z[2]], lambda r: {value})[1]), 'string_agg', '')"""

    urn_of = lambda x: f"'<urn:uuid:' || md5({x})[1:8] || '-' || md5({x})[9:12] || '-' || md5({x})[13:16] || '-' || md5({x})[17:20] || '-' || md5({x})[21:32] || '>'"
    nl = "chr(13) || chr(10)"
    return f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages
), r AS (
  SELECT *, 'sha256:' || sha256(payload) AS source_payload_digest, 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || strlen(payload) || {nl} AS http FROM p
), i AS (
  SELECT *, {urn_of("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || target_uri || '|" + DATE + "|' || source_payload_digest")} AS refers_to,
    regexp_replace(regexp_extract(payload, '<title[^>]*>(.*?)</title', 1, 'is'), '[\x00-\x20]+', ' ', 'g') AS raw_title, {plain("payload")} AS raw_text FROM r
), u AS (
  SELECT *, {unescaped("raw_title")} AS whole_title, {unescaped("raw_text")} AS whole_text FROM i
), t AS (
  SELECT *, trim(whole_title, ' ') AS title,
    trim(regexp_replace(regexp_replace(replace(whole_text, chr(160), ' '), ' +', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS txt,
    'sha256:' || sha256('HTTP/1.1 200 OK' || {nl} || http || {nl} || payload) AS response_digest FROM u
), d AS (
  SELECT page_id, 'metadata' AS warc_type, refers_to, target_uri, 'application/warc-fields' AS content_type, source_payload_digest,
    'title: ' || title || {nl} || 'html-lang: ' || regexp_extract(payload, '<html[^>]* lang="([^"]*)"', 1, 'i') || {nl} || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a [^>]*href=')) || {nl}
    || 'http-status: 200' || {nl} || 'source-block-digest: ' || response_digest || {nl} || 'source-' || replace(http, {nl} || 'Content-Length', {nl} || 'source-Content-Length') AS block FROM t
  UNION ALL
  SELECT page_id, 'conversion', refers_to, target_uri, 'text/plain; charset=utf-8', source_payload_digest, txt FROM t
), e AS (
  SELECT *, {urn_of("warc_type || '|' || refers_to")} AS record_id, '{DATE}' AS warc_date, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM d
)
SELECT page_id, warc_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest, source_payload_digest, block,
  'WARC/1.1' || {nl} || 'WARC-Type: ' || warc_type || {nl} || 'WARC-Record-ID: ' || record_id || {nl} || 'WARC-Refers-To: ' || refers_to || {nl} || 'WARC-Target-URI: ' || target_uri || {nl}
  || 'WARC-Date: ' || warc_date || {nl} || 'WARC-Block-Digest: ' || block_digest || {nl} || 'WARC-Source-Payload-Digest: ' || source_payload_digest || {nl}
  || 'Content-Type: ' || content_type || {nl} || 'Content-Length: ' || content_length || {nl} AS headers
FROM e
"""


ORACLE = _oracle()

"""WARC derivatives: metadata and plain-text conversion records linked to HTTP responses, in DataFrame functions only.

A response row has ``record_id``, ``target_uri``, ``warc_date``, ``http_head``
(status line and header lines) and ``body`` (HTML).  For each response two
records come out, each naming the response in WARC-Refers-To (with its URI and
date) and carrying SHA-1 digests in base32, as WARC files do:

* ``metadata`` (application/warc-fields): the source's status line and header
  lines, its payload digest, title, declared language and out-links;
* ``conversion`` (text/plain): the text of the page.

Record ids are name-based (md5 of the response id and the record type), so a
repeated run gives the same records.  ``record_text`` renders a record as it
stands in a WARC file.

Text of a page: comments, scripts, styles and ``head`` go; ends of block
elements become line ends; all other tags go; the named character references
``ENTITIES`` are resolved (``&amp;`` last); runs of blanks become one; empty
lines go.

Defined results: null in any column counts as empty text; an empty body gives a
conversion record of length 0; repeated responses give repeated records; an
empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named character references and the elements that end a line.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
#: (pattern, replacement) in order; Java and RE2 read them alike.
TEXT_RULES = (
    (r"(?is)<!--.*?-->", " "),
    (r"(?is)<head(\s[^>]*)?>.*?</head\s*>", " "),
    (r"(?is)<script(\s[^>]*)?>.*?</script\s*>", " "),
    (r"(?is)<style(\s[^>]*)?>.*?</style\s*>", " "),
    (r"[ \t\r\n\f]+", " "),
    (rf"(?i)</?({BLOCKS})(\s[^>]*)?/?>", "\n"),
    (r"<[^>]*>", ""),
)
BLANK_RULES = ((r"[ \t]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", ""))
TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
LANGUAGE = r"(?is)<html\s[^>]*lang\s*=\s*[\"']?([A-Za-z0-9-]+)"
LINK = r"(?is)<a\s[^>]*href\s*=\s*\"([^\"]*)\""
CRLF = "\r\n"


def base32_sha1(text: Column) -> Column:
    """``sha1:`` and the SHA-1 of the UTF-8 text in base32: each five hex digits are four base32 digits."""
    digest = F.sha1(text.cast("binary"))
    fours = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def uuid_of(name: Column) -> Column:
    """A name-based record id."""
    h = F.md5(name.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def resolved(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def tidy(text: Column) -> Column:
    for pattern, by in BLANK_RULES:
        text = F.regexp_replace(text, pattern, by)
    return text


def page_text(html: Column) -> Column:
    for pattern, by in TEXT_RULES:
        html = F.regexp_replace(html, pattern, by)
    return tidy(resolved(html))


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Response rows of crawled pages (page_id, url, html): the header lines say what is known of them."""
    url, body = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"))
    name = F.concat(F.lit("response "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), url)
    return pages.select("page_id", uuid_of(name).alias("record_id"), url.alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("warc_date"), head.alias("http_head"), body.alias("body"))


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows for each response: the ``keep`` columns, the record's headers as columns, and its block.

    The page is read once; both records are made from the same row.
    """
    given = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("record_id", "target_uri", "warc_date", "http_head", "body")}
    rows = responses.select(*keep, *[v.alias(f"_{c}") for c, v in given.items()])
    body = F.col("_body")
    links = F.array_distinct(F.regexp_extract_all(body, F.lit(LINK), F.lit(1)))
    rows = rows.select(
        "*", base32_sha1(body).alias("_payload"), page_text(body).alias("_text"),
        tidy(F.translate(resolved(F.regexp_extract(body, TITLE, 1)), CRLF, "  ")).alias("_title"), F.lower(F.regexp_extract(body, LANGUAGE, 1)).alias("_lang"),
        F.transform(links, lambda x: F.translate(resolved(x), CRLF, "  ")).alias("_links"),
    )
    fields = F.concat(
        F.lit("source-head: "), F.replace(F.col("_http_head"), F.lit(CRLF), F.lit(f"{CRLF}source-head: ")), F.lit(CRLF),
        F.lit("source-payload-digest: "), F.col("_payload"), F.lit(CRLF), F.lit("title: "), F.col("_title"), F.lit(CRLF), F.lit("language: "), F.col("_lang"), F.lit(CRLF),
        F.array_join(F.transform("_links", lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF))), ""),
    )
    two = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_text").alias("block")),
    )
    made = rows.withColumn("_one", F.explode(two))
    block = F.col("_one.block")
    return made.select(
        *keep,
        F.col("_one.type").alias("record_type"),
        uuid_of(F.concat(F.col("_one.type"), F.lit(" "), F.col("_record_id"))).alias("record_id"),
        F.col("_record_id").alias("refers_to"),
        F.col("_target_uri").alias("target_uri"),
        F.col("_warc_date").alias("refers_to_date"),
        F.col("_one.content_type").alias("content_type"),
        F.octet_length(block).cast("long").alias("content_length"),
        base32_sha1(block).alias("block_digest"),
        F.col("_payload").alias("source_payload_digest"),
        F.size("_links").cast("long").alias("n_links"),
        block.alias("block"),
    )


def record_text(records: DataFrame, name: str = "record") -> DataFrame:
    """With the whole record as it stands in a WARC file: version, headers, empty line, block, two line ends."""
    lines = [
        F.lit("WARC/1.1"),
        *[
            F.concat(F.lit(f"{label}: "), F.col(column).cast("string"))
            for label, column in (
                ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "refers_to_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
                ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
            )
        ],
    ]
    return records.withColumn(name, F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2)))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def derivatives_sql() -> str:
    """The same over ``pages`` in DuckDB SQL."""

    def rules(x: str, pairs) -> str:
        for pattern, by in pairs:
            x = f"regexp_replace({x}, {_sql_text(pattern)}, {_sql_text(by)}, 'g')"
        return x

    def entities(x: str) -> str:
        for name, char in ENTITIES:
            x = f"replace({x}, {_sql_text(name)}, {_sql_text(char)})"
        return x

    def digest(x: str) -> str:
        digits = "array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(sha1({0}), 1 + 5 * (k // 4), 5))::BIGINT // (1 << (5 * (3 - k % 4)))) % 32, 1)), '')"
        return "'sha1:' || " + digits.format(x)

    def uuid(x: str) -> str:
        h = f"md5({x})"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    flat = "replace(replace({0}, chr(13), ' '), chr(10), ' ')"
    crlf = "chr(13) || chr(10)"
    return f"""
WITH given AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS b FROM pages),
made AS (SELECT page_id, u, b, {uuid("'response ' || coalesce(page_id::VARCHAR, '') || ' ' || u")} AS source,
    {digest("b")} AS payload, {rules(entities(rules("b", TEXT_RULES)), BLANK_RULES)} AS body_text,
    {rules(flat.format(entities(f"regexp_extract(b, {_sql_text(TITLE)}, 1)")), BLANK_RULES)} AS title,
    lower(regexp_extract(b, {_sql_text(LANGUAGE)}, 1)) AS lang,
    regexp_extract_all(b, {_sql_text(LINK)}, 1) AS found FROM given),
linked AS (SELECT *, list_transform(list_filter(found, lambda x, i: list_position(found, x) = i), lambda x: {flat.format(entities("x"))}) AS links FROM made),
blocks AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'source-head: HTTP/1.1 200 OK' || {crlf} || 'source-head: Content-Type: text/html; charset=utf-8' || {crlf} || 'source-head: Content-Length: ' || strlen(b) || {crlf}
    || 'source-payload-digest: ' || payload || {crlf} || 'title: ' || title || {crlf} || 'language: ' || lang || {crlf}
    || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || x || {crlf}), ''), '') AS block FROM linked
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', body_text FROM linked)
SELECT page_id, record_type, {uuid("record_type || ' ' || source")} AS record_id, source AS refers_to, u AS target_uri, '2024-01-01T00:00:00Z' AS refers_to_date,
  content_type, strlen(block)::BIGINT AS content_length, {digest("block")} AS block_digest, payload AS source_payload_digest, len(links)::BIGINT AS n_links, block
FROM blocks
"""

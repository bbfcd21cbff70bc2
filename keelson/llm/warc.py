"""WARC derivatives: responses become linked metadata and plain-text conversion records.

For each response record two records are derived, both with ``WARC-Refers-To`` naming it and its target
address and date: ``metadata`` (``application/warc-fields``) keeps the response's status line and headers,
its payload digest, the page's title and links, and names the conversion; ``conversion`` is the page as plain
text. Ids are name-based, so reruns give the same ones. Everything is column expressions over
one row per page, without a shuffle; files are written by the text sink, whose separator is the
two line ends that close a WARC record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\r\n"

# fixed values: character references by name
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "trade": "™",
            "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“",
            "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "euro": "€", "deg": "°", "times": "×"}
# fixed values: patterns that Java's and RE2's engines read alike
HIDDEN = (r"(?is)<!--.*?-->|<script(?:[ \t\n\f\r/][^>]*)?>.*?</script[ \t\n\f\r]*>|<style(?:[ \t\n\f\r/][^>]*)?>.*?</style[ \t\n\f\r]*>"
          r"|<head(?:[ \t\n\f\r][^>]*)?>.*?</head[ \t\n\f\r]*>")
# the same as HIDDEN with the first character in front, where the engine can skip to it
_HIDDEN = (r"(?is)<(?:!--.*?-->|script(?:[ \t\n\f\r/][^>]*)?>.*?</script[ \t\n\f\r]*>|style(?:[ \t\n\f\r/][^>]*)?>.*?</style[ \t\n\f\r]*>"
           r"|head(?:[ \t\n\f\r][^>]*)?>.*?</head[ \t\n\f\r]*>)")
BREAKS = (r"(?i)</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|nav|footer|header|main|aside|pre|blockquote|hr|form"
          r"|body|html)(?:[ \t\n\f\r/][^>]*)?>")
TAGS = r"<[/!?A-Za-z][^>]*>"
TITLE = r"(?is)<title(?:[ \t\n\f\r][^>]*)?>(.*?)</title[ \t\n\f\r]*>"
HREF = r"(?i)<a[ \t\n\f\r](?:[^>]*[ \t\n\f\r])?href[ \t\n\f\r]*=[ \t\n\f\r]*[\"']([^\"'>]*)[\"']"
NUMBER = r"&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"


def _character(reference: Column) -> Column:
    """The character of a numeric reference; a number that names none becomes U+FFFD."""
    body = F.regexp_replace(reference, "[&#;]", "")
    code = F.when(F.lower(F.substring(body, 1, 1)) == "x", F.conv(F.substring(body, 2, 9), 16, 10)).otherwise(body).cast("long")
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    bits = F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")
    return F.decode(F.unhex(bits), "UTF-32")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(text: Column) -> Column:
    """Resolves the named references of ``ENTITIES``, numeric ones, and ``&amp;`` last."""
    values = F.create_map(*[F.lit(x) for name, value in ENTITIES.items() for x in (f"&{name};", value)])

    def numbers(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)))
        found = F.filter(found, lambda n: ~F.lower(n).isin("&#38;", "&#x26;"))
        return F.when(F.contains(t, F.lit("&#")), F.aggregate(found, t, lambda x, n: F.replace(x, n, _character(n)))).otherwise(t)

    def references(t: Column) -> Column:
        # one pass finds the names that occur; only those are replaced
        names = F.array_distinct(F.regexp_extract_all(t, F.lit(f"&(?:{'|'.join(ENTITIES)});"), F.lit(0)))
        named = F.aggregate(names, t, lambda x, n: F.replace(x, n, F.element_at(values, n)))
        return F.when(F.contains(t, F.lit("&")), F.regexp_replace(_let(named, numbers), "&(?:amp|#38|#[xX]26);", "&")).otherwise(t)

    return _let(text, references)


def _tidy(text: Column) -> Column:
    """One space for blanks, one line feed for blanks with a line end, none at the ends."""
    blank = lambda c: (c == " ") | (c == "\n")
    tidy = F.regexp_replace(F.regexp_replace(text, r"[ \t\f\x0B]+", " "), r" ?[\n\r][ \n\r]*", "\n")
    # one blank is left at either end at most
    head = _let(tidy, lambda t: F.when(blank(F.left(t, F.lit(1))), F.substr(t, F.lit(2))).otherwise(t))
    return _let(head, lambda t: F.when(blank(F.right(t, F.lit(1))), F.left(t, F.char_length(t) - 1)).otherwise(t))


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, _HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    return _tidy(unescape(text))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
              date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages: ``page_id, record_id, target_uri, date, headers, payload``.

    A null page body is an empty payload, a null address a record without one.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                       F.octet_length(payload).cast("string"), F.lit(END))
    return pages.select(F.col(page_id).alias("page_id"),
                        _uuid(F.lit("response"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")))
                        .alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).alias("date"),
                        headers.alias("headers"), payload.alias("payload"))


def derive(records: DataFrame) -> DataFrame:
    """Two derived records per response record, as rows.

    ``page_id, record_type, record_id, refers_to, target_uri, date, content_type, content_length,
    source_headers, source_digest, block_digest, block``. Empty payloads give an empty conversion and a
    metadata record without title and links; null addresses stay null; repeated responses give
    repeated records with the same ids. An empty table gives no rows.
    """
    own = records.select("page_id", "record_id", "target_uri", "date", "headers", _digest(F.col("payload")).alias("digest"),
                         plain_text(F.col("payload")).alias("plain"),
                         _tidy(unescape(F.regexp_extract("payload", TITLE, 1))).alias("title"),
                         F.regexp_extract_all("payload", F.lit(HREF), F.lit(1)).alias("links"),
                         _uuid(F.lit("conversion"), F.col("record_id")).alias("conversion_id"),
                         _uuid(F.lit("metadata"), F.col("record_id")).alias("metadata_id"))
    source = F.concat(F.lit("source-status: "), F.regexp_replace(F.rtrim(F.col("headers"), F.lit(END)), r"\r\n", f"{END}source-"), F.lit(END))
    title = F.regexp_replace("title", r"[\n\r]+", " ")
    links = F.transform("links", lambda link: F.concat(F.lit("outlink: "), F.regexp_replace(unescape(link), r"[\n\r]+", " "), F.lit(END)))
    fields = F.concat(source, F.lit("source-payload-digest: "), F.col("digest"), F.lit(f"{END}conversion: "), F.col("conversion_id"), F.lit(END),
                      F.when(title != "", F.concat(F.lit("title: "), title, F.lit(END))).otherwise(""), F.array_join(links, ""))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.col("metadata_id").alias("record_id"),
                 F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("record_id"),
                 F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("plain").alias("block")))
    rows = own.withColumnRenamed("record_id", "refers_to").withColumn("r", F.explode(kinds))
    return rows.select("page_id", "r.record_type", "r.record_id", "refers_to", "target_uri", "date", "r.content_type",
                       F.octet_length("r.block").cast("long").alias("content_length"), F.col("headers").alias("source_headers"),
                       F.col("digest").alias("source_digest"), _digest(F.col("r.block")).alias("block_digest"), "r.block")


def as_text(records: DataFrame) -> DataFrame:
    """One column ``value``: each derived record as WARC text, without the two closing line ends."""
    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit(END))

    head = F.concat(F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
                    line("WARC-Refers-To", F.col("refers_to")), F.coalesce(line("WARC-Target-URI", F.col("target_uri")), F.lit("")),
                    line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")),
                    line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")))
    return records.select(F.concat(head, F.lit(END), F.col("block")).alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files (one per partition) of derived records."""
    as_text(records).write.option("lineSep", END * 2).option("compression", compression).text(path)


def _duck_text(column: str) -> tuple[str, str]:
    """DuckDB SQL of :func:`unescape` and :func:`_tidy` for a column."""
    out = column
    for name, value in ENTITIES.items():
        out = f"replace({out}, '&{name};', '{value.replace(chr(39), chr(39) * 2)}')"
    quote = NUMBER.replace("'", "''")
    number = "regexp_replace(n, '[&#;]', '', 'g')"
    code = f"CASE WHEN lower({number}[1]) = 'x' THEN CAST(concat('0x', {number}[2:]) AS BIGINT) ELSE CAST({number} AS BIGINT) END"
    valid = f"CAST(CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN {code} ELSE 65533 END AS INTEGER)"
    refs = f"list_filter(list_distinct(regexp_extract_all({out}, '{quote}')), lambda n: lower(n) NOT IN ('&#38;', '&#x26;'))"
    out = f"list_reduce(list_prepend({out}, {refs}), lambda t, n: replace(t, n, chr({valid})))"
    out = f"regexp_replace({out}, '&(?:amp|#38|#[xX]26);', '&', 'g')"
    return out, f"trim(regexp_replace(regexp_replace({out}, '[ \\t\\f\\x0B]+', ' ', 'g'), ' ?[\\n\\r][ \\n\\r]*', chr(10), 'g'), concat(' ', chr(10)))"


def derive_sql(date: str = "1970-01-01T00:00:00Z") -> str:
    """DuckDB SQL of :func:`derive` over the responses of ``pages``."""
    def q(pattern):
        return "'" + pattern.replace("'", "''") + "'"

    def uuid(*parts):
        h = f"md5(concat_ws('|', {', '.join(parts)}))"
        cuts = ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"concat('<urn:uuid:', concat_ws('-', {cuts}), '>')"

    stripped = f"regexp_replace(regexp_replace(regexp_replace(payload, {q(HIDDEN)}, ' ', 'g'), {q(BREAKS)}, chr(10), 'g'), {q(TAGS)}, '', 'g')"
    crlf = "concat(chr(13), chr(10))"
    return f"""
WITH r AS (
  SELECT page_id, url AS target_uri, coalesce(html, '') AS payload,
         {uuid("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "coalesce(url, '')")} AS refers_to,
         concat('HTTP/1.1 200 OK', {crlf}, 'Content-Type: text/html; charset=utf-8', {crlf}, 'Content-Length: ',
                strlen(coalesce(html, '')), {crlf}) AS headers
  FROM pages),
s AS (
  SELECT *, {stripped} AS bare, regexp_extract(payload, {q(TITLE)}, 1) AS raw_title,
         regexp_extract_all(payload, {q(HREF)}, 1) AS raw_links, concat('sha256:', sha256(payload)) AS digest,
         {uuid("'conversion'", "refers_to")} AS conversion_id, {uuid("'metadata'", "refers_to")} AS metadata_id
  FROM r),
t AS (
  SELECT *, {_duck_text("bare")[1]} AS plain, regexp_replace({_duck_text("raw_title")[1]}, '[\\n\\r]+', ' ', 'g') AS title,
         list_transform(raw_links, lambda k: concat('outlink: ', regexp_replace({_duck_text("k")[0]}, '[\\n\\r]+', ' ', 'g'), {crlf})) AS links
  FROM s),
u AS (
  SELECT *, 'metadata' AS record_type, metadata_id AS record_id, 'application/warc-fields' AS content_type,
         concat('source-status: ', replace(rtrim(headers, {crlf}), {crlf}, concat({crlf}, 'source-')), {crlf}, 'source-payload-digest: ', digest,
                {crlf}, 'conversion: ', conversion_id, {crlf},
                CASE WHEN title <> '' THEN concat('title: ', title, {crlf}) ELSE '' END, array_to_string(links, '')) AS block FROM t
  UNION ALL
  SELECT *, 'conversion', conversion_id, 'text/plain; charset=utf-8', plain FROM t)
SELECT page_id, record_type, record_id, refers_to, target_uri, '{date}' AS date, content_type,
       CAST(strlen(block) AS BIGINT) AS content_length, headers AS source_headers, digest AS source_digest,
       concat('sha256:', sha256(block)) AS block_digest, block
FROM u"""

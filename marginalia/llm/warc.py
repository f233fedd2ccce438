"""Derivatives of archived responses: linked metadata and plain-text conversion records.

Everything is a column expression over the response's row, so nothing is shuffled. For each response there are two
records. Both keep the identifier they refer to, its target and date, the response's own headers (in the metadata
block) and the digest of its payload. Identifiers are drawn from the source's identifier and the record's
type, so a second run, or a task run again, makes the same records.

* conversion: the payload's text. Comments and elements that show nothing go, block elements end lines, other tags
  go, character references are resolved, blanks are collapsed.
* metadata: ``application/warc-fields`` with the source's place, headers, length and digest, the title and the links.

Cases: a null payload is empty; null identifiers, targets, dates or headers give empty values; repeated rows
give repeated records; an empty table gives none; line ends in a header value are written as %0D and %0A. A comment or
hidden element that is not closed goes on to the end. References in a title stay as they stand in the page.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: elements without text, elements that end a line, and character references
HIDDEN = ["script", "style", "noscript", "template"]
BLOCKS = "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
REFERENCES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "ndash": "–", "mdash": "—", "hellip": "…", "laquo": "«", "raquo": "»", "euro": "€", "deg": "°", "sect": "§"}
#: further names of character references
NAMED = {name[:-1]: sign for name, sign in html5.items() if name.endswith(";") and name[:-1] not in REFERENCES}
CONTENT = {"conversion": "text/plain; charset=utf-8", "metadata": "application/warc-fields"}
UNDATED = "1970-01-01T00:00:00Z"


def identifier(*parts: Column) -> Column:
    """A record identifier drawn from the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def _resolved(piece: Column) -> Column:
    """What a character reference stands for, with the text after it; ``piece`` comes after an ampersand."""
    number = F.regexp_extract(piece, "^#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});", 1)
    n = F.when(F.lower(F.substring(number, 1, 1)) == "x", F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).cast("int")
    real = ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n <= 0x10FFFF))
    letter = F.when(real, F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    out = F.when(piece.startswith("#") & (number != ""), F.concat(letter, F.substring(piece, F.length(number) + 3, F.length(piece))))
    for name, sign in REFERENCES.items():
        out = out.when(piece.startswith(name + ";"), F.concat(F.lit(sign), F.substring(piece, F.lit(len(name) + 2), F.length(piece))))
    # looked up only where a name that is not among the frequent ones stands
    named = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]{1,31});", 1)
    sign = F.when(named != "", F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), named))
    return out.otherwise(F.coalesce(F.concat(sign, F.substring(piece, F.length(named) + 2, F.length(piece))), F.concat(F.lit("&"), piece)))


def resolved(text: Column) -> Column:
    """Character references resolved; each ampersand is looked at once."""
    return F.array_join(F.transform(F.split(text, "&", -1), lambda x, i: F.when(i == 0, x).otherwise(_resolved(x))), "")


def plain_text(html: Column) -> Column:
    t = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:[\s/][^>]*)?>", "\n")
    t = F.regexp_replace(t, rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(HIDDEN)})(?:\s[^>]*)?>.*?(?:</\1\s*>|\z)|</?[A-Za-z!?][^>]*>", "")
    t = resolved(t)
    # single spaces, most of all blanks, stay as they are
    t = F.regexp_replace(t, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")
    t = F.regexp_replace(t, r"\x20\n[\x20\n]*|\n[\x20\n]+", "\n")
    return F.btrim(t, F.lit(" \n"))


def title(html: Column) -> Column:
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title(?:\s[^>]*)?>(.*?)</title", 1)
    return F.trim(F.regexp_replace(found, r"\s+", " "))


def links(html: Column) -> Column:
    """Targets of anchors, in order, character references resolved."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"'>]*)[\"']"), F.lit(1))
    return F.transform(found, lambda x: F.when(F.contains(x, F.lit("&")), resolved(x)).otherwise(x))


def _value(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _fields(pairs: list[tuple[str, Column]]) -> Column:
    return F.concat(*[F.concat(F.lit(f"{name}: "), _value(value), F.lit("\r\n")) for name, value in pairs])


def responses(pages: DataFrame, date: str = UNDATED) -> DataFrame:
    """Pages as responses: ``page_id, record_id, target_uri, date, headers, payload``."""
    page, url = F.col("page_id").cast("string"), F.col("url").cast("string")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headers = F.map_from_arrays(F.array(F.lit("Content-Length"), F.lit("Content-Type")), F.array(F.octet_length(payload).cast("string"), F.lit("text/html; charset=utf-8")))
    return pages.select("page_id", identifier(F.lit("response"), page, url).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), payload.alias("payload"))


def derivatives(source: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two records for each row of ``source(record_id, target_uri, date, headers, payload)``; ``keep``: other columns to carry."""
    html = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    given = F.array_sort(F.map_entries(F.coalesce(F.col("headers"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    lines = F.transform(given, lambda e: F.concat(F.lit("source-header-"), F.lower(e["key"]), F.lit(": "), _value(e["value"]), F.lit("\r\n")))
    outlinks = F.transform(links(html), lambda x: F.concat(F.lit("outlink: "), _value(x), F.lit("\r\n")))
    with_digest = source.withColumn("source_digest", digest(html))
    metadata = F.concat(
        _fields([
            ("source-record-id", F.col("record_id")), ("source-target-uri", F.col("target_uri")), ("source-date", F.col("date")), ("source-payload-digest", F.col("source_digest")),
            ("source-payload-length", F.octet_length(html).cast("string")), ("title", title(html)),
        ]),
        F.array_join(lines, ""), F.array_join(outlinks, ""),
    )
    kinds = F.array(F.struct(F.lit("conversion").alias("type"), plain_text(html).alias("block")), F.struct(F.lit("metadata").alias("type"), metadata.alias("block")))
    rows = with_digest.select(*(keep or []), "record_id", "target_uri", "date", "source_digest", F.explode_outer(kinds).alias("made"))
    block = F.col("made.block")
    return rows.select(
        *(keep or []), F.col("made.type").alias("type"), identifier(F.col("made.type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date",
        F.when(F.col("made.type") == "conversion", CONTENT["conversion"]).otherwise(CONTENT["metadata"]).alias("content_type"), F.octet_length(block).cast("long").alias("content_length"),
        "source_digest", digest(block).alias("block_digest"), block.alias("block"),
    )


def record(derived: DataFrame) -> Column:
    """A record as it stands in a file, without the two line ends after it."""
    head = _fields([
        ("WARC-Type", F.col("type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Refers-To", F.col("refers_to")), ("WARC-Refers-To-Target-URI", F.col("target_uri")), ("WARC-Refers-To-Date", F.col("date")),
        ("WARC-Source-Payload-Digest", F.col("source_digest")), ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    ])
    return F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), F.col("block"))


def write(derived: DataFrame, path: str) -> None:
    """Record files, one for each partition: records end with two line ends, as the text writer's row end."""
    derived.select(record(derived).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)

"""WARC derivatives: metadata and plain-text conversion records from responses.

A response record has record_id, target_uri, date, block (the HTTP message as text),
block_digest and payload_digest.  Each response gives one ``metadata`` record, which holds
its source headers and digests, and, if it is a successful answer of type text/html,
application/xhtml+xml or text/plain, one ``conversion`` record with its plain text.  Both
refer to the response by WARC-Refers-To, and the metadata record names the conversion.
Identifiers of derivatives are computed from the source's identifier, so that a task that
runs again writes the same records.

Defined results: a null block is empty; a message without an empty line has headers only;
a null record_id takes an identifier made of the address, date and block; null addresses,
dates and digests are empty; repeated rows give repeated records; other columns are kept
out; an empty table gives no records; texts are never cut.

All of it is DataFrame functions: no row leaves the JVM and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Elements whose contents are no text, and elements that end a line.
DROPPED_ELEMENTS = ("script", "style", "noscript", "template", "title", "textarea", "select")
LINE_ELEMENTS = (
    "address article aside blockquote body br caption dd details div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre "
    "section summary table tbody td tfoot th thead tr ul"
).split()
#: Named character references and their characters.
NAMED = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&middot;", "·"),
    ("&hellip;", "…"),
    ("&ndash;", "–"),
    ("&mdash;", "—"),
    ("&laquo;", "«"),
    ("&raquo;", "»"),
    ("&amp;", "&"),
)
#: Their tags, with the names grouped by first letter so that few are tried at each.
LINE_TAG = (
    "(?i)</?(?:"
    + "|".join(
        f"{letter}(?:{'|'.join(n[1:] for n in LINE_ELEMENTS if n[0] == letter)})"
        for letter in sorted({n[0] for n in LINE_ELEMENTS})
    )
    + r")\b[^>]*>"
)
#: Comments and elements without text, up to their ends or the end of the page.
NO_TEXT = r"(?is)<(?:!--.*?(?:-->|\z)|" + "|".join(rf"{n}\b[^>]*>.*?(?:</{n}\s*>|\z)" for n in DROPPED_ELEMENTS) + ")"
#: White space that is not one blank already, anywhere and within a line.
WHITE_RUN = r"[ \t\n\f\r]{2,}|[\t\n\f\r]"
LINE_WHITE_RUN = r"[ \t\f\r]{2,}|[\t\f\r]"
TEXT_TYPES = ("text/html", "application/xhtml+xml", "text/plain")


def urn(text: Column) -> Column:
    """An identifier of the form urn:uuid, computed from a text."""
    h = F.sha2(text, 256)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(
        F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3),
        F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12),
    )


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def _character(number: Column) -> Column:
    """A code point as text; U+FFFD where there is no such character."""
    real = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    bits = F.unhex(F.lpad(F.hex(F.when(real, number).otherwise(F.lit(0xFFFD))), 8, "0"))
    return F.decode(bits, "UTF-32")


def decode_references(text: Column) -> Column:
    """Numeric character references and the named ones of ``NAMED``."""

    def piece(part: Column, i: Column) -> Column:
        decimal = F.regexp_extract(part, r"^([0-9]{1,7});", 1)
        hexadecimal = F.regexp_extract(part, r"^[xX]([0-9A-Fa-f]{1,6});", 1)
        rest = F.regexp_replace(part, r"^[^;]*;", "")
        return (
            F.when(i == 0, part)
            .when(decimal != "", F.concat(_character(decimal.cast("long")), rest))
            .when(hexadecimal != "", F.concat(_character(F.conv(hexadecimal, 16, 10).cast("long")), rest))
            .otherwise(F.concat(F.lit("&#"), part))
        )

    def decoded(t: Column) -> Column:
        numeric = F.array_join(F.transform(F.split(t, "&#"), piece), "")
        out = F.when(F.contains(t, F.lit("&#")), numeric).otherwise(t)
        for name, character in NAMED:
            out = F.replace(out, F.lit(name), F.lit(character))
        return F.when(F.contains(t, F.lit("&")), out).otherwise(t)

    return let(text, decoded)


def plain_text(html: Column) -> Column:
    """The text of a page, one line for each block."""
    out = F.regexp_replace(html, NO_TEXT, " ")
    out = F.regexp_replace(out, WHITE_RUN, " ")
    out = F.regexp_replace(out, LINE_TAG, "\n")
    out = F.regexp_replace(out, r"<[a-zA-Z/!?][^>]*>", "")
    return tidy(decode_references(out))


def tidy(text: Column) -> Column:
    """Single spaces, single line ends, nothing at either end."""
    out = F.regexp_replace(text, LINE_WHITE_RUN, " ")
    out = F.regexp_replace(out, r" \n[ \n]*|\n[ \n]+", "\n")
    return F.btrim(out, F.lit(" \n"))


def derive(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records: warc_type, record_id, refers_to, target_uri,
    date, content_type, block, block_digest, content_length, header."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    source = responses.select(
        F.coalesce(F.col("record_id"), urn(F.concat_ws("|", text("target_uri"), text("date"), text("block")))).alias("source_id"),
        *[text(c).alias(c) for c in ("target_uri", "date", "block", "block_digest", "payload_digest")],
    )
    at = F.instr("block", "\r\n\r\n")
    source = source.select(
        "*",
        F.when(at > 0, F.substr("block", F.lit(1), at - 1)).otherwise(F.col("block")).alias("http"),
        F.when(at > 0, F.substr("block", at + 4)).otherwise(F.lit("")).alias("payload"),
    ).drop("block")
    source = source.withColumns(
        {
            "status": F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]{3})", 1),
            "media": F.lower(F.regexp_extract("http", r"(?i)\r\nContent-Type:[ \t]*([^;\r\n \t]*)", 1)),
        }
    )
    converts = F.col("status").startswith("2") & F.col("media").isin(*TEXT_TYPES)
    source = source.withColumns(
        {
            "conversion_id": F.when(converts, urn(F.concat("source_id", F.lit("|conversion")))),
            "text": F.when(~converts, F.lit(None))
            .when(F.col("media") == "text/plain", tidy(F.col("payload")))
            .otherwise(plain_text(F.col("payload"))),
        }
    ).drop("payload")
    fields = F.concat(
        F.lit("source-record: "), F.col("source_id"),
        F.lit("\r\nsource-block-digest: "), F.col("block_digest"),
        F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"),
        F.lit("\r\nconversion-record: "), F.coalesce("conversion_id", F.lit("none")),
        F.lit("\r\nhttp-status: "), F.col("status"),
        F.lit("\r\nhttp-headers:\r\n "), F.regexp_replace("http", r"\r\n", "\r\n "),
        F.lit("\r\n"),
    )

    def record(kind: str, number: Column, media: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"),
            number.alias("record_id"),
            F.lit(media).alias("content_type"),
            block.alias("block"),
        )

    both = F.array_compact(
        F.array(
            record("metadata", urn(F.concat("source_id", F.lit("|metadata"))), "application/warc-fields", fields),
            F.when(
                F.col("conversion_id").isNotNull(),
                record("conversion", F.col("conversion_id"), "text/plain; charset=utf-8", F.col("text")),
            ),
        )
    )
    records = source.select(
        F.col("source_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.inline(both)
    ).withColumns(
        {
            "block_digest": digest(F.col("block")),
            "content_length": F.octet_length("block").cast("long"),
        }
    )
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    angled = lambda value: F.concat(F.lit("<"), value, F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("warc_type")),
        line("WARC-Record-ID", angled(F.col("record_id"))),
        line("WARC-Refers-To", angled(F.col("refers_to"))),
        line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("date")),
        line("WARC-Source-Payload-Digest", F.col("payload_digest")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
        F.lit("\r\n\r\n"),
    )
    return records.select(
        "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type",
        "block", "block_digest", "content_length", header.alias("header"),
    )


def record_text(records: DataFrame) -> Column:
    """A record as it stands in a WARC file: header, block, two line ends."""
    return F.concat(records["header"], records["block"], F.lit("\r\n\r\n"))


def responses_from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records of one crawl."""
    html = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    made = pages.select(
        urn(F.concat(F.lit("page|"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(head, html).alias("block"),
        digest(html).alias("payload_digest"),
    )
    return made.withColumn("block_digest", digest(F.col("block")))


def derivative_digests(pages: DataFrame) -> DataFrame:
    """Records of a table of pages, with digests in place of header and block."""
    records = derive(responses_from_pages(pages))
    return records.select(
        "warc_type", "record_id", "refers_to", "target_uri", "block_digest", "content_length",
        F.sha2("header", 256).alias("header_sha256"),
    )

"""Text helpers for symbols, sources and error bodies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Phrases looked for in provider error pages, in reporting order.
ERROR_PAGE_PHRASES = [
    ("Your access has been blocked due to security concerns.", "Your access has been blocked due to security concerns."),
    ("We advise you to clean the cookies and try again.", "We advise you to clean the cookies and try again."),
    ("HTTP status code: 400", "HTTP status code: 400."),
]
ERROR_PAGE_LENGTH = 240

# Which data provider a source address belongs to.
SOURCE_HOSTS = [
    ("data.ecb.europa.eu", "ECB"),
    ("fred.stlouisfed.org", "FRED"),
    ("db.nomics.world", "AMECO"),
    ("ec.europa.eu", "AMECO"),
]

# Unicode white space written out, so every regex engine agrees on the class.
WHITE_SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

WHITE_SPACE_CHARACTERS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def listing_symbol(symbol: Column) -> Column:
    """Symbol without the US listing suffix."""
    return F.regexp_replace(symbol, r"\.US$", "")


def source_name(url: Column) -> Column:
    """Provider name for a source address, else its host name, else the text itself; null if empty."""
    known = F.lit(None).cast("string")
    for host, name in reversed(SOURCE_HOSTS):
        known = F.when(url.contains(host), F.lit(name)).otherwise(known)
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(url != "", F.coalesce(known, host, url))


def page_text(html: Column) -> Column:
    """Tags dropped, white space collapsed."""
    bare = F.regexp_replace(html, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, WHITE_SPACE + "+", " "))


def error_page_summary(html: Column) -> Column:
    """Known phrases of an error page, or the start of its text."""
    text = page_text(html)
    found = F.concat_ws(" ", *[F.when(text.contains(needle), F.lit(phrase)) for needle, phrase in ERROR_PAGE_PHRASES])
    return F.when(found != "", found).otherwise(F.left(text, F.lit(ERROR_PAGE_LENGTH)))


def fetch_error_message(error: Column, url: Column, body: Column, summarise_html: bool = True) -> Column:
    """One-line message for a failed request, with the response body or its summary."""
    head = F.concat(error, F.lit(" for URL "), url)
    with_body = F.when(F.coalesce(body, F.lit("")) != "", F.concat(head, F.lit(". Response body: "), body)).otherwise(head)
    if not summarise_html:
        return with_body
    summary = error_page_summary(body)
    return F.when(F.lower(body).contains("<html") & (summary != ""),
                  F.concat(head, F.lit(". Summary: "), summary)).otherwise(with_body)


def tenor_rank(tenor: Column) -> Column:
    return F.when(tenor == "3M", 1).when(tenor == "6M", 2).when(tenor == "12M", 3).otherwise(99)

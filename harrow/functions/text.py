"""Text and markup functions that need no document tree. Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BODY = r"(?is)<body[^>]*>(.*?)</body>"
SCRIPT, STYLE, TAG = r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]*>"


def once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fixed(number: Column, digits: int) -> Column:
    """A number with so many decimals as C's printf rounds it: by its exact binary value, ties to the even digit."""
    return F.call_function("format_number", number.cast("double"), F.lit("0." + "0" * digits))


def trim(text: Column) -> Column:
    """Strip all white space at both ends, not the space alone."""
    return F.regexp_replace(text, r"^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$", "")


def inner_body(html: Column) -> Column:
    """What is between the first body tag and the end tag after it; null without both. Linear however the page is broken."""
    rest = F.get(F.split(F.get(F.split(html, "(?i)<body", 2), F.lit(1)), ">", 2), F.lit(1))
    return once(F.split(rest, "(?i)</body>", 2), lambda x: F.when(F.size(x) > 1, F.get(x, F.lit(0))))


def body(html: Column) -> Column:
    return F.coalesce(inner_body(html), html)


def without(text: Column, flags: str, opening: str, rest: str) -> Column:
    """``text`` without the matches of ``opening`` and ``rest``.

    The first opening that has no end takes what follows with it and puts it back, so nothing is scanned twice.
    """
    return F.regexp_replace(text, f"(?{flags}){opening}(?:{rest}|(?<=({opening}))(.*+))", "$1$2")


def without_scripts(text: Column) -> Column:
    return without(text, "is", "<script", ".*?</script>")


def without_tags(text: Column) -> Column:
    return without(text, "s", "<", "[^>]*+>")


def text_of(html: Column) -> Column:
    """Without scripts, styles and tags, trimmed."""
    return trim(without_tags(without(without_scripts(html), "is", "<style", ".*?</style>")))


def body_text(html: Column) -> Column:
    return text_of(body(html))


def sanitize(html: Column) -> Column:
    """Tags out, six entities decoded (&amp; first), white space collapsed."""
    out = without_tags(html)
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return trim(F.regexp_replace(out, r"\s+", " "))


def crude(html: Column, cut: int = 500_000, size: int = 120_000) -> Column:
    """Tags to spaces, white space collapsed, of the first ``cut`` characters; at most ``size``."""

    def spaced(x: Column) -> Column:
        tail = F.substring_index(x, ">", -1)  # holds no whole tag
        return F.concat(F.regexp_replace(F.left(x, F.length(x) - F.length(tail)), TAG, " "), tail)

    return F.substring(trim(F.regexp_replace(once(F.substring(html, 1, cut), spaced), r"\s+", " ")), 1, size)


def truncated(text: Column, size: int, mark: str) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def title(html: Column) -> Column:
    """The first title on one line; without an end tag no place is tried."""
    return F.when(html.rlike("(?i)</title>"), F.regexp_extract(html, r"(?i)<title[^>]*>(.*?)</title>", 1)).otherwise("")


def contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def matches_any(text: Column, patterns) -> Column:
    """One alternation, so the engine scans once."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def line_array(text: Column) -> Column:
    return F.split(text, "\n")

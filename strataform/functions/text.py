"""Text expressions whose white space is that of Unicode, not of ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def instant(text: Column) -> Column:
    """An RFC 3339 text as an instant; null where it is null or unreadable."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.upper(text)))


def trim_all(text: Column) -> Column:
    """Trim white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only texts."""
    return text.isNull() | ~text.rlike(r"(?U)\S")


#: The white space characters of the ECMAScript language, and the rules of titles and sentences made with them.  Both
#: Spark's expressions and the chunker's plain functions use these very patterns.
WHITE = "\t\n\v\f\r                  　﻿"


LINK = r"\[([^\]]*)\]\([^)]*\)"
EMPHASIS = r"[*_`]"
CLOSING_MARKS = rf"[{WHITE}]+#+[{WHITE}]*$"
AFTER_STOP = rf"(?<=[.!?])[{WHITE}]+"
EDGES = rf"^[{WHITE}]+|[{WHITE}]+$"


def collapse_space(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x{FEFF}]+", " "))


def snippet(text: Column, limit: int = 180) -> Column:
    """The beginning of a text on one line; a cut one ends with an ellipsis."""
    line = collapse_space(text)
    return F.when(F.length(line) > limit, F.concat(F.rtrim(F.substring(line, 1, limit)), F.lit("…"))).otherwise(line)


def clean_inline(text: Column) -> Column:
    """A heading without links, emphasis and closing marks."""
    shown = F.regexp_replace(F.regexp_replace(text, LINK, "$1"), EMPHASIS, "")
    return F.regexp_replace(F.regexp_replace(shown, CLOSING_MARKS, ""), EDGES, "")


def sentences(text: Column) -> Column:
    """A text cut after full stops, exclamation and question marks."""
    return F.filter(F.split(text, AFTER_STOP), lambda s: F.length(s) > 0)


def xml_escape(text: Column) -> Column:
    """The five characters that XML reserves, the ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


def epoch_millis(text: Column) -> Column:
    """Milliseconds since 1970 of an RFC 3339 text; 0 where it is null or unreadable."""
    return F.coalesce(F.unix_millis(instant(text)), F.lit(0))

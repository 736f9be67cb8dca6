"""Column expressions on URLs and lines of text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site_of(url: Column) -> Column:
    """Host in lower case without user, port and a leading `www.`; null where `url` has no authority."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def normal_line(line: Column) -> Column:
    """Trimmed, lower case, each run of white space one blank, each run of digits one `0`."""
    squeezed = F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), r"^ | $", "")
    return F.regexp_replace(F.lower(squeezed), r"\p{Nd}+", "0")


def has_letters(line: Column, least: int) -> Column:
    """Whether `line` holds at least `least` Unicode letters."""
    return line.rlike(r"^(?:[^\p{L}]*+\p{L}){%d}" % least)

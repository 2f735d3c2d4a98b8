"""String functions with the semantics of Unicode-aware text cleaning, as column expressions."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import applied
from .udfs import lazy_udf

#: Java's Unicode blanks lack the four separators U+001C..U+001F.
BLANK = r"[\s\x1c-\x1f]"
_WIDE_DIGITS = "０１２３４５６７８９—‒–"
_PLAIN_DIGITS = "0123456789---"


def quoted(literal: str) -> str:
    """A literal inside a Java pattern."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def strip(text: Column) -> Column:
    """Without blanks of any script at both ends (``trim`` only knows the space)."""
    return F.regexp_replace(text, f"(?U)\\A{BLANK}+|{BLANK}+\\z", "")


def squeeze(text: Column) -> Column:
    """Without any blanks."""
    return F.regexp_replace(text, f"(?U){BLANK}+", "")


def clean_text(text: Column) -> Column:
    """Full-width digits and long dashes made plain, blanks at line ends and runs of empty lines removed, ends stripped."""
    plain = F.translate(text, _WIDE_DIGITS, _PLAIN_DIGITS)
    plain = F.regexp_replace(plain, "[ \t]+\n", "\n")
    return strip(F.regexp_replace(plain, "\n{3,}", "\n\n"))


def chars(text: Column) -> Column:
    """The code points of a text as an array; empty for an empty text."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def ngrams(text: Column, n: int = 2) -> Column:
    """Runs of ``n`` code points of the text without blanks, in order and with repeats."""
    return F.regexp_extract_all(squeeze(text), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def chunks(text: Column, size: int = 400) -> Column:
    """The stripped text in pieces of ``size`` code points; one empty piece for an empty text."""
    pieces = F.regexp_extract_all(strip(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return applied(pieces, "CASE WHEN size(t) = 0 THEN array('') ELSE t END")


def first_number(text: Column) -> Column:
    """The first number of a text without thousands separators; null where there is none."""
    found = F.regexp_extract(F.translate(text, ",，", ""), r"(?U)-?\d+(?:\.\d+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def extract_fields(text: Column, labels: list[str]) -> Column:
    """map label -> value of each "label: value" found first; labels not found are absent."""
    pairs = []
    for label in labels:
        pattern = f"(?U){quoted(label)}{BLANK}*[:：=]{BLANK}*([^\\n\\r|]{{1,80}})"
        pairs.append(F.when(F.regexp_like(text, F.lit(pattern)), F.struct(F.lit(label).alias("key"), strip(F.regexp_extract(text, pattern, 1)).alias("value"))))
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def label_list(labels: str) -> list[str]:
    """Labels of a comma-separated list, either comma, trimmed, empty ones dropped."""
    return [part.strip() for part in re.split("[,，]", labels) if part.strip()]


@lazy_udf("string")
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def html_unescape(text: Column) -> Column:
    """All named and numeric character references resolved (Spark has no such function)."""
    return F.when(F.contains(text, F.lit("&")), _unescape(text)).otherwise(text)

"""Tables as Markdown, and HTML tables as rows, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import html_unescape, strip


def _cell(value: Column) -> Column:
    value = F.coalesce(value, F.lit(""))
    return strip(F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def table_to_markdown(rows: Column) -> Column:
    """array<array<string>> to a Markdown table: the first row heads it, short rows are padded.

    A null, empty or header-less table gives ''. Null cells are empty, bars are escaped.
    """
    width = F.array_max(F.transform(rows, F.size))

    def line(row: Column) -> Column:
        padded = F.concat(F.transform(row, _cell), F.array_repeat(F.lit(""), width - F.size(row)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))

    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line)
    text = F.concat(F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), body), "\n"), F.lit("\n"))
    return F.when((F.coalesce(F.size(rows), F.lit(0)) <= 0) | (F.coalesce(F.size(F.get(rows, F.lit(0))), F.lit(0)) <= 0), F.lit("")).otherwise(text)


def html_table_to_rows(html: Column) -> Column:
    """Rows of cells of the HTML text's tables; rows with nothing in them are dropped."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))

    def cells(row: Column) -> Column:
        found = F.regexp_extract_all(row, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
        return F.transform(found, lambda c: F.regexp_replace(c, "<[^>]+>", ""))

    # references are resolved once, over all cells in one string joined by characters HTML cannot hold
    joined = F.array_join(F.transform(rows, lambda r: F.concat(F.array_join(F.transform(cells(r), lambda c: F.concat(c, F.lit("\u0001"))), ""))), "\u0002")
    split_rows = F.split(html_unescape(joined), "\u0002")
    parsed = F.transform(
        split_rows, lambda r: F.transform(F.filter(F.split(r, "\u0001"), lambda c, i: i < F.size(F.split(r, "\u0001")) - 1), strip)
    )
    return F.when(F.size(rows) > 0, F.filter(parsed, lambda r: F.exists(r, lambda c: c != ""))).otherwise(F.array().cast("array<array<string>>"))


def html_table_to_markdown(html: Column) -> Column:
    """The tables of an HTML text as one Markdown table; the rows are parsed once and bound to a variable."""
    return F.get(F.transform(F.array(html_table_to_rows(html)), table_to_markdown), F.lit(0))

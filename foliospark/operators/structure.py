"""Extraction results as one Markdown text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tables import table_to_markdown
from ..functions.text import clean_text, strip

PAGE = "struct<page:int,text:string,tables:array<array<array<string>>>,ocr:boolean>"
RAW = f"struct<type:string,text:string,pages:array<{PAGE}>>"


def structure_pages(pages: Column) -> Column:
    """Pages as Markdown: headings only where there is more than one page, cleaned text, numbered tables."""
    several = F.size(pages) > 1

    def page(p: Column) -> Column:
        heading = F.when(several, F.concat(F.lit("\n## 第 "), p["page"].cast("string"), F.lit(" 頁\n"))).otherwise(F.lit(""))
        body = F.when(F.length(F.coalesce(p["text"], F.lit(""))) > 0, clean_text(p["text"])).otherwise(F.lit(""))
        tables = F.coalesce(p["tables"], F.array().cast("array<array<array<string>>>"))
        drawn = F.transform(
            tables, lambda t, i: F.when(table_to_markdown(t) != "", F.concat(F.lit("\n### 表格 "), (i + 1).cast("string"), F.lit("\n\n"), table_to_markdown(t))).otherwise(F.lit(""))
        )
        return F.concat(F.array(heading, body), drawn)

    parts = F.filter(F.flatten(F.transform(pages, page)), lambda s: s != "")
    return strip(F.array_join(parts, "\n"))


def structure(raw: Column) -> Column:
    """The Markdown of an extraction: its pages if it has any list of them, else its cleaned text."""
    return F.when(raw["pages"].isNotNull(), structure_pages(raw["pages"])).otherwise(clean_text(F.coalesce(raw["text"], F.lit(""))))

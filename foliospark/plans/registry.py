"""The registry of the core queries and what their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table, text_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Blanks of any script, for the oracle's regular expressions.
B = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '\\A{B}+|{B}+\\z', '', 'g')"


def clean_sql(text: str) -> str:
    plain = f"translate({text}, '０１２３４５６７８９—‒–', '0123456789---')"
    return strip_sql(f"regexp_replace(regexp_replace({plain}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def query(oracle: str | None = None):
    """Register a query under its name, with its oracle if SQL can express it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Results with redelivered rows counted once; they are equal but for the time of loading."""
    return table(spark, sf_dir, "doc_results").select("result_id", *columns).dropDuplicates(["result_id"])


def results(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Results as delivered. What is a function of a row is computed first and counted once after, so that
    no text is shuffled to find redelivered rows."""
    return text_rows(spark, sf_dir, "doc_results", "result_id", *columns)


RESULTS = "(SELECT * FROM doc_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY loaded_at) = 1)"


# ---- check digits in SQL

TW_ID_SQL = "chr(CAST(65 + {0} % 26 AS INTEGER)) || CAST(1 + {0} % 2 AS VARCHAR) || lpad(CAST(({0} * 7919) % 100000000 AS VARCHAR), 8, '0')"
COMPANY_SQL = "lpad(CAST(({0} * 104729) % 100000000 AS VARCHAR), 8, '0')"
CARD_SQL = "'4' || lpad(CAST(({0}::HUGEINT * 15485863) % 1000000000000000 AS VARCHAR), 15, '0')"
MOBILE_SQL = "'09' || lpad(CAST({0} % 100000000 AS VARCHAR), 8, '0')"
_LETTER_LIST = "[10,11,12,13,14,15,16,17,34,18,19,20,21,22,35,23,24,25,26,27,28,29,32,30,31,33]"


def digit_sql(text: str, place: int) -> str:
    return f"TRY_CAST(substr({text}, {place}, 1) AS INTEGER)"


def id_sum_sql(text: str) -> str:
    code = f"({_LETTER_LIST})[ascii({text}) - 64]"
    return f"({code} // 10 + ({code} % 10) * 9 + " + " + ".join(f"{digit_sql(text, i + 2)} * {w}" for i, w in enumerate((8, 7, 6, 5, 4, 3, 2, 1, 1))) + ")"


def id_ok_sql(text: str) -> str:
    return f"(regexp_full_match({text}, '[A-Z][12][0-9]{{8}}') AND {id_sum_sql(text)} % 10 = 0)"


def company_ok_sql(text: str) -> str:
    total = " + ".join(f"({digit_sql(text, i + 1)} * {w}) // 10 + ({digit_sql(text, i + 1)} * {w}) % 10" for i, w in enumerate((1, 2, 1, 2, 1, 2, 4, 1)))
    return f"(regexp_full_match({text}, '[0-9]{{8}}') AND (({total}) % 5 = 0 OR (substr({text}, 7, 1) = '7' AND ({total} + 1) % 5 = 0)))"


def luhn_ok_sql(text: str) -> str:
    digit = f"CAST(substr({text}, CAST(i AS INTEGER), 1) AS INTEGER)"
    double = f"CASE WHEN (length({text}) - i) % 2 = 1 THEN (2 * {digit}) // 10 + (2 * {digit}) % 10 ELSE {digit} END"
    return f"(list_sum(list_transform(range(1, length({text}) + 1), lambda i: {double})) % 10 = 0)"

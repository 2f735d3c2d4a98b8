"""Rules against a plain version built on ``re``."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions.validators import VALIDATORS
from foliospark.operators import pii

from .test_functions import many, plain_company, plain_identity, plain_luhn

RULES = pii.BUILTIN_RULES + pii.rules_from_yaml(pii.SHIPPED_YAML)
CHECKS = {"tw_id": plain_identity, "tw_company_id": plain_company, "luhn": plain_luhn}
ATOMS = [
    "身分證", "A123456789", "b", "電話", " ", "，", "0912-345-678", "0911222333", "(02)2345-6789", "tel ", "信用卡 ", "4111 1111 1111 1111", "統編", "04595257", "12345678", "護照", "123456789",
    "AB1234567", "帳號", "98765432101", "臺中市西屯區文心路三段12號5樓", "台中市西屯區文心路12號", "姓名：", "趙大同", "申請人: 錢小美", "出生", "1990/1/2", "2001年3月4日", "健保", "000012345678",
    "居留", "C812345678", "車牌", "ABC-1234", "a.b+c@d-e.co", "９", "😀", "\n", "x", "7", "hotel", "《", "-",
]


def plain_detect(text):
    found = []
    for no, rule in enumerate(RULES):
        for m in re.finditer(rule.regex, text):
            if rule.validator and not CHECKS[rule.validator](m.group()):
                continue
            around = text[max(0, m.start() - 30) : m.end() + 30]
            if rule.context_required and not any(w in around for w in rule.context_words):
                continue
            found.append((rule.entity, m.start(), m.end(), m.group(), rule.score, no))
    kept = []
    for f in sorted(found, key=lambda f: (-f[4], f[1] - f[2], f[1], f[5])):
        if all(f[2] <= k[1] or f[1] >= k[2] for k in kept):
            kept.append(f)
    return [f[:4] for f in sorted(kept, key=lambda f: f[1])]


def plain_mask(text, operator):
    out, at = "", 0
    labels = {r.entity: r.label for r in RULES}
    for entity, a, b, found in plain_detect(text):
        digest = hashlib.sha256(found.encode()).hexdigest()[:8]
        out += text[at:a] + {"replace": f"《{labels[entity]}》", "redact": "", "hash": f"《{labels[entity]}#{digest}》"}[operator]
        at = b
    return out + text[at:]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["", "沒有", *("".join(rng.choice(ATOMS) for _ in range(rng.randint(2, 16))) for _ in range(300))]


def test_detection_equals_plain_version(spark, texts):
    found = many(spark, texts, lambda c: pii.detect(c, RULES))
    got = [[(f["entity"], f["start"], f["end"], f["text"]) for f in row] for row in found]
    assert got == [plain_detect(t) for t in texts]
    assert len({f[0] for row in got for f in row}) >= 12


@pytest.mark.parametrize("operator", ["replace", "redact", "hash", "keep"])
def test_masking(spark, texts, operator):
    got = many(spark, texts, lambda c: pii.mask(c, pii.detect(c, RULES), operator))
    assert got == (texts if operator == "keep" else [plain_mask(t, operator) for t in texts])


def test_unknown_operator(spark):
    with pytest.raises(ValueError):
        pii.mask(F.lit("x"), F.array(), "blur")


def test_report_and_nulls(spark):
    df = spark.createDataFrame([(1, "寄 a@b.tw 或 c@d.tw"), (2, None), (3, "")], "k int, body string")
    rows = {r["k"]: r["pii_report"] for r in pii.analyze_and_mask(df, "body").collect()}
    assert (rows[1]["pii_count"], rows[1]["pii_types"], rows[1]["masked_text"]) == (2, ["EMAIL"], "寄 《電子郵件》 或 《電子郵件》")
    assert rows[2]["pii_count"] == 0 and rows[2]["masked_text"] is None and rows[3]["masked_text"] == ""


def test_number_covered_once(spark):
    [masked] = many(spark, ["匯款帳號驗證手機 0912345678 謝謝"], lambda c: pii.mask(c, pii.detect(c, RULES), "replace"))
    assert masked == "匯款帳號驗證手機 《手機號碼》 謝謝"


def test_guard_goes_by_the_rule_not_its_name(spark):
    own = pii.PiiRule("EMAIL", "信箱", r"\w+ \(at\) \w+")
    other = pii.PiiRule("MAIL", "信箱", r"\w+ \(at\) \w+")
    for rule in (own, other):
        [found] = many(spark, ["寫信 a (at) b"], lambda c: pii.detect(c, (rule,)))
        assert [f["text"] for f in found] == ["a (at) b"]


def test_many_findings(spark):
    text = "".join(f"a{i}@b.tw 0912-345-678," for i in range(300))
    [found] = many(spark, [text], lambda c: pii.detect(c, RULES))
    assert [(f["entity"], f["start"], f["end"], f["text"]) for f in found] == plain_detect(text)
    [masked] = many(spark, [text], lambda c: pii.mask(c, pii.detect(c, RULES), "replace"))
    assert masked == plain_mask(text, "replace")


def test_validator_registered_as_a_column_function(spark, monkeypatch):
    monkeypatch.setitem(VALIDATORS, "even", lambda c: c.cast("int") % 2 == 0)
    rule = pii.PiiRule("EVEN", "偶數", r"\d+", validator="even")
    [found] = many(spark, ["3 4 10 7"], lambda c: pii.detect(c, (rule,)))
    assert [f["text"] for f in found] == ["4", "10"]


def test_yaml_rules(tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("pii_rules:\n  - {name: BADGE, regex: 'K-\\d+'}\n", encoding="utf-8")
    [rule] = pii.load_custom_rules(path)
    assert (rule.label, rule.score, rule.context_required) == ("BADGE", 0.7, False)
    path.write_text("pii_rules:\n  - {name: BADGE, regex: '('}\n", encoding="utf-8")
    assert pii.load_custom_rules(path) == () and pii.load_custom_rules(tmp_path / "none") == ()
    for bad in ("pii_rules: 3", "- a", "pii_rules: [{name: A}]", "pii_rules: [{name: A, regex: x, score: high}]", "a: [", "pii_rules: [x]"):
        assert pii.rules_from_yaml(bad) == ()
    assert pii.rule_or_fault({"name": "A", "regex": "x", "validator": "nobody's", "more": 1}) == pii.PiiRule("A", "A", "x", 0.7)
    assert len(pii.all_rules(pii.SHIPPED)) == 14 and len(pii.all_rules()) == 11 and len(pii.rules_from_yaml(pii.SHIPPED_YAML)) == 3

"""Rule-based personal data: detection with offsets, overlap resolution, masking and reports.

Everything is native expressions: all matches of a rule come from one ``regexp_extract_all`` and their
offsets from the lengths of what ``split`` leaves between them, so texts never leave the JVM.
"""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import BLOCK, applied, bound, literal, running_sql
from ..functions.validators import VALIDATOR_SQL, VALIDATORS

FINDING = "struct<entity:string,label:string,start:int,end:int,text:string,score:double,rule_no:int>"
OPERATORS = ("replace", "redact", "hash", "keep")


@dataclass(frozen=True)
class PiiRule:
    """A pattern of Unicode-aware syntax common to Python and Java, and what a match must also satisfy."""

    entity: str
    label: str
    regex: str
    score: float = 0.8
    validator: str | None = None
    context_words: tuple[str, ...] = field(default=())
    context_required: bool = False
    context_window: int = 30


# The built-in rules in the order that breaks ties.
BUILTIN_RULES: tuple[PiiRule, ...] = (
    PiiRule("TW_ID_NUMBER", "身分證字號", r"(?<![A-Z0-9])[A-Z][12]\d{8}(?!\d)", 0.95, "tw_id"),
    PiiRule("TW_MOBILE", "手機號碼", r"(?<!\d)09\d{2}[\s-]?\d{3}[\s-]?\d{3}(?!\d)", 0.85),
    PiiRule("TW_LANDLINE", "市話號碼", r"(?<!\d)\(?0\d{1,2}\)?[\s-]?\d{3,4}[\s-]?\d{4}(?!\d)", 0.6, None, ("電話", "聯絡", "TEL", "Tel", "tel", "分機"), True),
    PiiRule("EMAIL", "電子郵件", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.9),
    PiiRule("CREDIT_CARD", "信用卡號", r"(?<!\d)(?:\d[ -]?){13,19}(?<![ -])(?!\d)", 0.9, "luhn", ("卡號", "信用卡", "VISA", "Master", "JCB", "刷卡"), True),
    PiiRule("TW_COMPANY_ID", "統一編號", r"(?<!\d)\d{8}(?!\d)", 0.75, "tw_company_id", ("統編", "統一編號", "公司", "營業人", "買受人"), True),
    PiiRule("PASSPORT", "護照號碼", r"(?<![A-Z0-9])[0-9]{9}(?![0-9])|(?<![A-Z0-9])[A-Z]{1,2}\d{7,8}(?!\d)", 0.6, None, ("護照", "Passport", "passport", "PASSPORT"), True),
    PiiRule("BANK_ACCOUNT", "銀行帳號", r"(?<!\d)\d{10,16}(?!\d)", 0.6, None, ("帳號", "帳戶", "匯款", "銀行", "郵局", "轉帳"), True),
    PiiRule("TW_ADDRESS", "地址", r"[一-鿿]{1,4}[縣市][一-鿿]{1,4}[區鄉鎮市][一-鿿0-9]{1,20}?[路街道巷弄][0-9０-９\-之]{1,8}號(?:[0-9０-９]{1,3}樓)?", 0.85),
    PiiRule("PERSON_NAME_FIELD", "姓名", r"(?<=姓名[:：])[ 　]?[一-鿿]{2,4}|(?<=申請人[:：])[ 　]?[一-鿿]{2,4}|(?<=立書人[:：])[ 　]?[一-鿿]{2,4}|(?<=收件人[:：])[ 　]?[一-鿿]{2,4}", 0.85),
    PiiRule("BIRTHDAY_FIELD", "出生日期", r"(?:19|20)\d{2}[./年-]\s?\d{1,2}[./月-]\s?\d{1,2}日?", 0.5, None, ("出生", "生日", "誕生"), True),
)

#: Names the rules below where a path to a file of rules is expected.
SHIPPED = "shipped"
# The rules shipped as a configuration file.
SHIPPED_YAML = """pii_rules:
  - {name: NHI_CARD, label: 健保卡號, regex: '(?<!\\d)\\d{12}(?!\\d)', score: 0.7, context_words: ["健保", "健保卡"]}
  - {name: TW_RESIDENT_ID, label: 居留證號, regex: '(?<![A-Z0-9])[A-Z][89]\\d{8}(?!\\d)', score: 0.85, context_words: ["居留", "居留證", "ARC"]}
  - {name: VEHICLE_PLATE, label: 車牌號碼, regex: '(?<![A-Z0-9])[A-Z]{2,3}-?\\d{3,4}(?![A-Z0-9])', score: 0.6, context_words: ["車牌", "車號", "牌照"]}
"""


_TEXT, _WORDS = (str,), (list, tuple)
#: What a rule of a YAML text may say: the type of each key.
RULE_KEYS = {"name": _TEXT, "label": _TEXT, "regex": _TEXT, "score": (int, float), "validator": (str, type(None)), "context_words": _WORDS, "context_required": (bool,)}


def rule_or_fault(entry: object) -> PiiRule | str:
    """The rule that one YAML entry describes, or what is wrong with it. Keys not known are left aside."""
    if not isinstance(entry, dict) or not {"name", "regex"} <= entry.keys():
        return "a rule needs a name and a regex"
    given = {k: entry[k] for k in RULE_KEYS if k in entry}
    wrong = [k for k, v in given.items() if not isinstance(v, RULE_KEYS[k])]
    if wrong:
        return f"rule {entry['name']}: wrong type of {', '.join(wrong)}"
    try:
        re.compile(given["regex"])
    except re.error as fault:
        return f"rule {entry['name']}: {fault}"
    entity, words = given.pop("name"), tuple(given.pop("context_words", ()))
    validator = given.pop("validator", None)
    defaults = {"label": entity, "score": 0.7, "context_required": bool(words)}
    return PiiRule(entity=entity, context_words=words, validator=validator if validator in VALIDATORS else None, **(defaults | given))


def rules_from_yaml(source: str) -> tuple[PiiRule, ...]:
    """Rules of a YAML text; any fault in it gives none at all."""
    if importlib.util.find_spec("yaml") is None:
        return ()
    import yaml

    try:
        document = yaml.safe_load(source)
    except yaml.YAMLError:
        return ()
    entries = document.get("pii_rules") if isinstance(document, dict) else None
    rules = [rule_or_fault(entry) for entry in entries] if isinstance(entries, list) else []
    return () if any(isinstance(rule, str) for rule in rules) else tuple(rules)


def load_custom_rules(path: str | Path) -> tuple[PiiRule, ...]:
    """Rules of a YAML file; a missing or faulty file gives none."""
    try:
        return rules_from_yaml(Path(path).read_text(encoding="utf-8"))
    except OSError:
        return ()


def all_rules(custom: str | Path | None = None, rules: tuple[PiiRule, ...] | None = None) -> tuple[PiiRule, ...]:
    """The built-in rules (or ``rules``), then those of the file ``custom``; ``"shipped"`` names the rules shipped."""
    extra = () if not custom else rules_from_yaml(SHIPPED_YAML) if custom == SHIPPED else load_custom_rules(custom)
    return (BUILTIN_RULES if rules is None else tuple(rules)) + extra


def java_pattern(regex: str) -> str:
    """The pattern with Python's Unicode classes; Java's blanks lack four separators."""
    widened = re.sub(r"\[\\s-\]", r"[\\s\\x1c-\\x1f-]", regex)
    return "(?U)" + re.sub(r"(?<!\\)(?<!\[)\\s(?![^\[]*\])", r"[\\s\\x1c-\\x1f]", widened)


#: A pattern that every match of a built-in rule holds, so that most texts are spared the rule's own pattern.
_NECESSARY = {"EMAIL": "@", "TW_ADDRESS": "號", "TW_MOBILE": "09", "PERSON_NAME_FIELD": "[名人][:：]", "TW_ID_NUMBER": "[A-Z][12]"}
_NONE = f"CAST(array() AS array<{FINDING}>)"


def _holds(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {literal(word)})" for word in words) + ")"


def _guard(rule: PiiRule) -> str:
    """A cheap necessary condition: context words; for a built-in rule (the rule itself, not its name) what its pattern needs; else the pattern."""
    if rule.context_required and rule.context_words:
        return _holds("t", rule.context_words)
    if rule.entity in _NECESSARY and any(rule.regex == r.regex for r in BUILTIN_RULES if r.entity == rule.entity):
        needed = _NECESSARY[rule.entity]
        return f"regexp_like(t, {literal(needed)})" if "[" in needed else f"contains(t, {literal(needed)})"
    return f"regexp_like(t, {literal(java_pattern(rule.regex))})"


def _passes(rule: PiiRule) -> str | None:
    """What a match ``f`` of the rule must satisfy beside its pattern, if anything."""
    checks = [VALIDATOR_SQL[rule.validator]("f.text")] if rule.validator in VALIDATOR_SQL else []
    if rule.context_required and rule.context_words:
        low = f"greatest(f.start - {rule.context_window}, 0)"
        checks.append(bound(f"substr(t, {low} + 1, f.`end` + {rule.context_window} - {low})", "w", _holds("w", rule.context_words)))
    return " AND ".join(checks) or None


def found_sql(rules: tuple[PiiRule, ...], numbers: Iterable[int]) -> str:
    """Findings of the rules in the text ``t``, rule by rule: leftmost matches that pass their rule's validator and context, in order."""
    numbered = list(zip(numbers, rules))

    def matched(no: int, rule: PiiRule) -> str:
        # matches and the gaps between them; both come from running the pattern over the text
        pattern = literal(java_pattern(rule.regex))
        both = f"named_struct('m', regexp_extract_all(t, {pattern}, 0), 'gap', transform(split(t, {pattern}, -1), g -> length(g)))"
        about = f"'entity', {literal(rule.entity)}, 'label', {literal(rule.label)}, 'score', {float(rule.score)!r}D, 'no', {no}"
        return f"named_struct({about}, 'x', CASE WHEN {_guard(rule)} THEN {both} END)"

    def finding(m: str, start: str, end: str) -> str:
        return f"named_struct('entity', r.entity, 'label', r.label, 'start', CAST({start} AS INT), 'end', CAST({end} AS INT), 'text', {m}, 'score', r.score, 'rule_no', r.no)"

    # a fold over the gaps gives the offsets; as it copies its result for every match, many matches get running sums
    start = "acc.at + r.x.gap[size(acc.out)]"
    step = f"named_struct('at', CAST({start} + length(m) AS INT), 'out', CAST(concat(acc.out, array({finding('m', start, f'{start} + length(m)')})) AS array<{FINDING}>))"
    few = f"aggregate(r.x.m, named_struct('at', 0, 'out', {_NONE}), (acc, m) -> {step}, acc -> acc.out)"
    lengths = "zip_with(slice(r.x.gap, 1, size(r.x.m)), r.x.m, (g, m) -> g + length(m))"
    many = f"zip_with(r.x.m, {running_sql(lengths, lambda a, b: f'{a} + {b}')}, (m, e) -> {finding('m', 'e - length(m)', 'e')})"
    all_matches = ", ".join(matched(no, rule) for no, rule in numbered)
    found = f"flatten(transform(filter(array({all_matches}), r -> size(r.x.m) > 0), r -> CASE WHEN size(r.x.m) <= {BLOCK} THEN {few} ELSE {many} END))"
    checks = "".join(f"WHEN {no} THEN {check} " for no, rule in numbered if (check := _passes(rule)))
    return f"filter({found}, f -> CASE f.rule_no {checks}ELSE true END)" if checks else found


def rule_matches(text: Column, rule: PiiRule, rule_no: int) -> Column:
    """The findings of one rule in a column; none in a null text."""
    found = applied(text, f"coalesce({found_sql((rule,), (rule_no,))}, {_NONE})")
    if rule.validator and rule.validator not in VALIDATOR_SQL:  # one registered as a column function only
        found = F.filter(found, lambda f: VALIDATORS[rule.validator](f["text"]))
    return found


def matches(text: Column, rules: tuple[PiiRule, ...] = BUILTIN_RULES) -> Column:
    """The findings of all rules, rule by rule, before overlaps are resolved; none in a null text."""
    return applied(text, f"coalesce({found_sql(tuple(rules), range(len(rules)))}, {_NONE})")


def _by(*keys: str) -> str:
    """A comparator of findings by the keys in turn; a key with a minus goes down."""
    ways = "".join(f"WHEN {a}.{k.lstrip('-')} < {b}.{k.lstrip('-')} THEN -1 WHEN {a}.{k.lstrip('-')} > {b}.{k.lstrip('-')} THEN 1 " for k in keys for a, b in [("q", "p") if k[0] == "-" else ("p", "q")])
    return f"(p, q) -> CASE {ways}ELSE 0 END"


def resolved_sql(findings: str) -> str:
    """Of overlapping findings the better ones (score, then length, then place, then rule order), by start.

    The better ones are kept one after another. Many findings are first sorted by start and cut where none
    reaches over, since what is kept is searched for every finding; such clusters stay small however long the text.
    """
    taken = "exists(kept, k -> f.start < k.`end` AND k.start < f.`end`)"
    ranked = "transform(c, f -> named_struct('f', f, 'score', f.score, 'size', f.`end` - f.start, 'start', f.start, 'rule_no', f.rule_no))"
    order = f"transform(array_sort({ranked}, {_by('-score', '-size', 'start', 'rule_no')}), r -> r.f)"
    greedy = f"aggregate({order}, {_NONE}, (kept, f) -> CASE WHEN {taken} THEN kept ELSE concat(kept, array(f)) END)"
    best = f"CASE WHEN size(c) < 2 THEN c ELSE array_sort({greedy}, {_by('start')}) END"
    ends = running_sql("transform(s, f -> f.`end`)", lambda a, b: f"greatest({a}, {b})")
    starts = "filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i].start >= get(reach, i - 1))"
    clusters = bound(starts, "cut", "transform(cut, (a, i) -> slice(s, a + 1, coalesce(get(cut, i + 1), size(s)) - a))")
    apart = f"flatten(transform({bound(ends, 'reach', clusters)}, c -> {best}))"
    sorted_once = bound(f"array_sort(c, {_by('start', '`end`', 'rule_no')})", "s", apart)
    return bound(findings, "c", f"CASE WHEN size(c) <= {BLOCK} THEN {best} ELSE {sorted_once} END")


def resolve_overlaps(findings: Column) -> Column:
    """``resolved_sql`` of a column."""
    return applied(findings, resolved_sql("t"))


def detect(text: Column, rules: tuple[PiiRule, ...] = BUILTIN_RULES) -> Column:
    """All findings of a text, resolved; an empty array for a null text."""
    if not rules:
        return F.array().cast(f"array<{FINDING}>")
    if any(rule.validator and rule.validator not in VALIDATOR_SQL for rule in rules):
        found = resolve_overlaps(F.concat(*[rule_matches(text, rule, i) for i, rule in enumerate(rules)]))
        return F.when(text.isNotNull(), found).otherwise(F.array().cast(f"array<{FINDING}>"))
    return applied(text, f"CASE WHEN t IS NULL THEN {_NONE} ELSE {resolved_sql(found_sql(tuple(rules), range(len(rules))))} END")


def mask(text: Column, findings: Column, operator: str = "replace") -> Column:
    """The text with each finding replaced (labelled), redacted, hashed or kept. Findings must be by start."""
    if operator not in OPERATORS:
        raise ValueError(f"未知的遮蔽模式：{operator}")
    if operator == "keep":
        return text
    stand_in = {"redact": "''", "hash": "concat('《', f.label, '#', substr(sha2(f.text, 256), 1, 8), '》')", "replace": "concat('《', f.label, '》')"}[operator]
    # what stands before each finding, then its stand-in, then what is left
    before = "CASE WHEN i = 0 THEN 0 ELSE x.f[i - 1].`end` END"
    parts = f"transform(x.f, (f, i) -> concat(substr(x.t, {before} + 1, f.start - {before}), {stand_in}))"
    spliced = f"concat(array_join({parts}, ''), substr(x.t, element_at(x.f, -1).`end` + 1))"
    return applied(F.struct(text.alias("t"), findings.alias("f")), f"CASE WHEN x.t IS NULL OR size(x.f) = 0 THEN x.t ELSE {spliced} END", "x")


def report(findings: Column, masked: Column) -> Column:
    """pii_count, sorted distinct entities and labels, and the masked text."""
    distinct = "array_sort(array_distinct(transform(x.f, f -> f.{})))".format
    made = f"named_struct('pii_count', size(x.f), 'pii_types', {distinct('entity')}, 'pii_labels', {distinct('label')}, 'masked_text', x.m)"
    return applied(F.struct(findings.alias("f"), masked.alias("m")), made, "x")


def with_findings(df: DataFrame, column: str, rules: tuple[PiiRule, ...] = BUILTIN_RULES, out: str = "findings") -> DataFrame:
    """Adds the findings of a text column. A projection of its own: what uses them twice reads them once."""
    return df.withColumn(out, detect(F.col(column), rules))


def analyze_and_mask(df: DataFrame, column: str, operator: str = "replace", rules: tuple[PiiRule, ...] = BUILTIN_RULES) -> DataFrame:
    """Adds ``findings`` and ``pii_report``."""
    found = with_findings(df, column, rules)
    return found.withColumn("pii_report", report(F.col("findings"), mask(F.col(column), F.col("findings"), operator)))

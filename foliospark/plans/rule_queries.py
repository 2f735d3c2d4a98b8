"""Queries of all rules over whole texts, with oracles.

SQL engines for analytics have no lookaround. The oracle therefore marks where runs of digits (or of capitals
and digits) begin and end, matches against the marked text, and takes the marks out again: a rule's
lookarounds become marks it must touch. Offsets are sums over the pieces between the matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pii
from .registry import RESULTS, B, company_ok_sql, id_ok_sql, luhn_ok_sql, query, results

ALL_RULES = pii.all_rules(pii.SHIPPED)

_OPEN, _SHUT = "", ""
_PLAIN = "text"
_DIGITS = f"regexp_replace(text, '(\\p{{Nd}}+)', '{_OPEN}\\1{_SHUT}', 'g')"
_CODES = f"regexp_replace(text, '([A-Z0-9]+)', '{_OPEN}\\1{_SHUT}', 'g')"
_GAP = B[:-1] + "-]"
_D = "\\p{Nd}"
_NUMBER_GAP = f"(?:{_SHUT}{_GAP}{_OPEN})?"

#: How the oracle finds each rule's matches: the text to search, the pattern, and the part of a match that is the finding.
_HOW: dict[str, tuple[str, str, str | None]] = {
    "TW_ID_NUMBER": (_CODES, f"{_OPEN}[A-Z][12][0-9]{{8}}[A-Z{_SHUT}]", "[A-Z][12][0-9]{8}"),
    "TW_MOBILE": (_DIGITS, f"{_OPEN}09{_D}{{2}}{_NUMBER_GAP}{_D}{{3}}{_NUMBER_GAP}{_D}{{3}}{_SHUT}", None),
    "TW_LANDLINE": (_DIGITS, f"\\(?{_OPEN}0{_D}{{1,2}}(?:{_SHUT}\\){_GAP}?{_OPEN}|{_SHUT}{_GAP}{_OPEN})?{_D}{{3,4}}{_NUMBER_GAP}{_D}{{4}}{_SHUT}", None),
    "EMAIL": (_PLAIN, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", None),
    "CREDIT_CARD": (_DIGITS, f"{_OPEN}{_D}+{_SHUT}(?:[ -]{_OPEN}{_D}+{_SHUT})*", None),
    "TW_COMPANY_ID": (_DIGITS, f"{_OPEN}{_D}{{8}}{_SHUT}", None),
    "PASSPORT": (_CODES, f"{_OPEN}(?:[0-9]{{9}}|[A-Z]{{1,2}}[0-9]{{7,8}})[A-Z{_SHUT}]", "[0-9]{9}|[A-Z]{1,2}[0-9]{7,8}"),
    "BANK_ACCOUNT": (_DIGITS, f"{_OPEN}{_D}{{10,16}}{_SHUT}", None),
    "TW_ADDRESS": (_PLAIN, "[一-鿿]{1,4}[縣市][一-鿿]{1,4}[區鄉鎮市][一-鿿0-9]{1,20}?[路街道巷弄][0-9０-９\\-之]{1,8}號(?:[0-9０-９]{1,3}樓)?", None),
    "PERSON_NAME_FIELD": (_PLAIN, "(?:姓名|申請人|立書人|收件人)[:：][ 　]?[一-鿿]{2,4}", "[ 　]?[一-鿿]{2,4}$"),
    "BIRTHDAY_FIELD": (_PLAIN, f"(?:19|20){_D}{{2}}[./年-]{B}?{_D}{{1,2}}[./月-]{B}?{_D}{{1,2}}日?", None),
    "NHI_CARD": (_DIGITS, f"{_OPEN}{_D}{{12}}{_SHUT}", None),
    "TW_RESIDENT_ID": (_CODES, f"{_OPEN}[A-Z][89][0-9]{{8}}[A-Z{_SHUT}]", "[A-Z][89][0-9]{8}"),
    "VEHICLE_PLATE": (_CODES, f"{_OPEN}[A-Z]{{2,3}}(?:{_SHUT}-{_OPEN})?[0-9]{{3,4}}{_SHUT}", None),
}
_CHECK = {"tw_id": id_ok_sql("found"), "tw_company_id": company_ok_sql("found")}


def _bare(text: str) -> str:
    return f"translate({text}, '{_OPEN}{_SHUT}', '')"


def _rule_sql(no: int, rule: pii.PiiRule, source: str) -> str:
    """key, text, no, entity, label, score, s, e, found of one rule's findings."""
    searched, pattern, part = _HOW[rule.entity]
    pieces = f"SELECT key, text, regexp_extract_all(m, '{pattern}') AS ms, string_split_regex(m, '{pattern}') AS gs FROM (SELECT key, text, {searched} AS m FROM {source})"
    before = "CAST(coalesce(list_sum(list_transform({0}, lambda x: length(" + _bare("x") + "))), 0) AS BIGINT)"
    each = f"SELECT key, text, {_bare('ms[i]')} AS whole, {before.format('gs[1:i]')} + {before.format('ms[1:i - 1]')} AS pos FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({pieces}))"
    found = f"regexp_extract(whole, '{part}')" if part else "whole"
    place = "pos + length(whole) - length(found)" if part and part.endswith("$") else "pos"
    rows = f"SELECT key, text, {no} AS no, '{rule.entity}' AS entity, '{rule.label}' AS label, {rule.score}::DOUBLE AS score, {place} AS s, {place} + length(found) AS e, found FROM (SELECT *, {found} AS found FROM ({each}))"
    checks = []
    if rule.validator == "luhn":
        digits = "regexp_replace(found, '[ -]', '', 'g')"
        checks.append(f"length({digits}) BETWEEN 13 AND 19 AND {luhn_ok_sql(digits)}")
    elif rule.validator:
        checks.append(_CHECK[rule.validator])
    if rule.context_required and rule.context_words:
        around = f"substr(text, greatest(s - {rule.context_window}, 0) + 1, e + {rule.context_window} - greatest(s - {rule.context_window}, 0))"
        checks.append("(" + " OR ".join(f"contains({around}, '{w}')" for w in rule.context_words) + ")")
    return f"SELECT * FROM ({rows})" + (f" WHERE {' AND '.join(checks)}" if checks else "")


def findings_sql(source: str, rules: tuple[pii.PiiRule, ...] = ALL_RULES) -> str:
    """CTEs over ``source`` (key, text): all findings as ``found_all``, and for each key the kept ones, by start, as ``kept_all``."""
    every = " UNION ALL ".join(_rule_sql(no, rule, source) for no, rule in enumerate(rules))
    one = "struct_pack(s := s, e := e, no := no, entity := entity, label := label, found := found)"
    clear = "len(list_filter(acc, lambda k: x[1].s < k.e AND k.s < x[1].e)) > 0"
    return f"""found_all AS ({every}),
    ranked AS (SELECT key, array_agg([{one}] ORDER BY score DESC, e - s DESC, s, no) AS fs FROM found_all GROUP BY key),
    greedy AS (SELECT key, list_reduce(fs, lambda acc, x: CASE WHEN {clear} THEN acc ELSE list_concat(acc, x) END) AS fs FROM ranked),
    kept_all AS (SELECT key, list_sort(fs) AS fs FROM greedy)"""


def masked_sql(stand_in: str, source: str) -> str:
    """key, fs, masked: the texts of ``source`` with their kept findings replaced."""
    end = "CASE WHEN i = 1 THEN 0 ELSE fs[i - 1].e END"
    parts = f"list_transform(range(1, len(fs) + 1), lambda i: substr(text, {end} + 1, fs[i].s - {end}) || {stand_in})"
    return f"SELECT key, fs, CASE WHEN fs IS NULL THEN text ELSE array_to_string({parts}, '') || substr(text, fs[len(fs)].e + 1) END AS masked FROM {source} LEFT JOIN kept_all USING (key)"


_TEXTS = f"texts AS (SELECT result_id AS key, structured_text AS text FROM {RESULTS})"
_ROWS = "unnest(fs) AS f FROM kept_all"


@query(f"""WITH {_TEXTS}, {findings_sql("texts")}
    SELECT key AS result_id, entity, s AS start_pos, e AS end_pos, found FROM found_all""")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the fourteen rules alone finds in each result: pattern, check digit and context, before overlaps are resolved."""
    rows = results(spark, sf_dir, "structured_text").select("result_id", F.explode(pii.matches(F.col("structured_text"), ALL_RULES)).alias("f"))
    return _rows(rows, "result_id").distinct()


def _rows(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "f.entity", F.col("f.start").cast("bigint").alias("start_pos"), F.col("f.end").cast("bigint").alias("end_pos"), F.col("f.text").alias("found"))


@query(f"""WITH {_TEXTS}, {findings_sql("texts")}
    SELECT key AS result_id, f.entity AS entity, f.s AS start_pos, f.e AS end_pos, f.found AS found FROM (SELECT key, {_ROWS})""")
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of all rules in each result, overlaps resolved."""
    found = results(spark, sf_dir, "structured_text").select("result_id", F.explode(pii.detect(F.col("structured_text"), ALL_RULES)).alias("f"))
    return _rows(found, "result_id").distinct()


_DISTINCT = "coalesce(array_to_string(list_sort(list_distinct(list_transform(fs, lambda f: f.{}))), ','), '')"


@query(f"""WITH {_TEXTS}, {findings_sql("texts")}, masked AS ({masked_sql("'《' || fs[i].label || '》'", "texts")})
    SELECT key AS result_id, CAST(coalesce(len(fs), 0) AS INTEGER) AS pii_count, {_DISTINCT.format("entity")} AS pii_types, {_DISTINCT.format("label")} AS pii_labels, md5(masked) AS masked FROM masked""")
def pii_report_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all fourteen rules over all results."""
    found = pii.analyze_and_mask(results(spark, sf_dir, "structured_text"), "structured_text", "replace", ALL_RULES)
    types, labels = (F.array_join(f"pii_report.{c}", ",").alias(c) for c in ("pii_types", "pii_labels"))
    return found.select("result_id", "pii_report.pii_count", types, labels, F.md5("pii_report.masked_text").alias("masked")).dropDuplicates(["result_id"])


def _masked(spark: SparkSession, sf_dir: str, operator: str) -> DataFrame:
    rows = pii.with_findings(results(spark, sf_dir, "structured_text"), "structured_text", ALL_RULES)
    return rows.select("result_id", F.md5(pii.mask(F.col("structured_text"), F.col("findings"), operator)).alias("masked")).dropDuplicates(["result_id"])


@query(f"""WITH {_TEXTS}, {findings_sql("texts")}
    SELECT key AS result_id, md5(masked) AS masked FROM ({masked_sql("'《' || fs[i].label || '#' || substr(sha256(fs[i].found), 1, 8) || '》'", "texts")})""")
def mask_hash_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result with its findings hashed."""
    return _masked(spark, sf_dir, "hash")


@query(f"""WITH {_TEXTS}, {findings_sql("texts")} SELECT key AS result_id, md5(masked) AS masked FROM ({masked_sql("''", "texts")})""")
def mask_redact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result with its findings cut out."""
    return _masked(spark, sf_dir, "redact")

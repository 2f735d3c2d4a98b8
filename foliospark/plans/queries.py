"""Registry of the core queries and their oracles. Every query runs over its whole tables and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..errors import MESSAGES
from ..functions import tables as T
from ..functions import text as X
from ..functions import validators as V
from ..operators import audit, batch, compare, pii, routing, structure
from ..sources.extract import extract, read_text
from ..sources.tables import table, text_rows
from ..streaming.pipeline import status_windows
from . import rule_queries  # noqa: F401  registers its queries
from .file_queries import scratch
from .pipeline import results_of, route
from .registry import COMPANY_SQL, CARD_SQL, MOBILE_SQL, ORACLES, QUERIES, RESULTS, TW_ID_SQL, B, clean_sql, company_ok_sql, id_ok_sql, id_sum_sql, luhn_ok_sql, once, query, results, strip_sql

# ---- structuring ----------------------------------------------------------------------------------


@query(f"""
    WITH c AS (SELECT doc_id, {clean_sql("(text || '　１２３—４５  ' || chr(10) || chr(10) || chr(10) || chr(10) || '末')")} AS t FROM documents)
    SELECT doc_id, md5(t) AS cleaned, CAST(coalesce(length(t), 0) AS BIGINT) AS n_chars FROM c""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_rows(spark, sf_dir, "documents", "doc_id", "text")
    cleaned = X.clean_text(F.concat("text", F.lit("　１２３—４５  \n\n\n\n末")))
    return docs.select("doc_id", cleaned.alias("t")).select("doc_id", F.md5("t").alias("cleaned"), F.coalesce(F.length("t"), F.lit(0)).cast("bigint").alias("n_chars"))


_PAGE = clean_sql("text")


@query(f"""
    WITH p AS (SELECT result_id, page, any_value(text) AS text FROM page_extracts GROUP BY 1, 2),
    n AS (SELECT *, count(*) OVER (PARTITION BY result_id) AS pages FROM p),
    parts AS (
        SELECT result_id, page, 0 AS part, chr(10) || '## 第 ' || page || ' 頁' || chr(10) AS s FROM n WHERE pages > 1
        UNION ALL SELECT result_id, page, 1, {_PAGE} FROM n WHERE coalesce(text, '') <> ''),
    j AS (SELECT result_id, string_agg(s, chr(10) ORDER BY page, part) AS t FROM parts WHERE s <> '' GROUP BY 1)
    SELECT i.result_id, md5({strip_sql("coalesce(j.t, '')")}) AS markdown FROM (SELECT DISTINCT result_id FROM p) i LEFT JOIN j USING (result_id)""")
def pages_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_extracts").select("result_id", "page", "text", "ocr").dropDuplicates(["result_id", "page"])
    page = F.struct("page", "text", F.array().cast("array<array<array<string>>>").alias("tables"), "ocr")
    pages = rows.groupBy("result_id").agg(F.array_sort(F.collect_list(page), lambda a, b: a["page"] - b["page"]).alias("pages"))
    return pages.select("result_id", F.md5(structure.structure_pages(F.col("pages"))).alias("markdown"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


@query("""
    WITH r AS (SELECT r_regionkey, n_nationkey, '| ' || n_nationkey || ' | a\\|' || n_name || ' |  |' || chr(10) AS line FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT CAST(r_regionkey AS BIGINT) AS region,
        '| key | name | note |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, '' ORDER BY n_nationkey) AS markdown FROM r GROUP BY 1""")
def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.array(F.col("n_nationkey").cast("string"), F.concat(F.lit(" a|"), F.col("n_name")))
    rows = _nations(spark, sf_dir).groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("s"))
    whole = F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("note"))), F.transform("s", lambda s: s["row"]))
    return rows.select(F.col("r_regionkey").cast("bigint").alias("region"), T.table_to_markdown(whole).alias("markdown"))


@query("""
    SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS row_no,
        n_nationkey || '|' || n_name || ' & co|<' || lower(n_name) || '>' AS cells FROM nation""")
def html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(
        F.lit("<TR class='x'>\n<th>"), F.col("n_nationkey").cast("string"), F.lit("</th><td align=left> <b>"), F.col("n_name"), F.lit("</b> &amp; co</td><td>&lt;"),
        F.lower("n_name"), F.lit("&gt;</td></TR><tr><td> </td></tr>"),
    )
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", cell.alias("c")))).alias("s"))
    html = F.concat(F.lit("<table>"), F.array_join(F.transform("s", lambda s: s["c"]), ""), F.lit("</table>"))
    parsed = rows.select("n_regionkey", F.posexplode(T.html_table_to_rows(html)).alias("row_no", "cells"))
    return parsed.select(F.col("n_regionkey").cast("bigint").alias("region"), F.col("row_no").cast("bigint").alias("row_no"), F.array_join("cells", "|").alias("cells"))


_LABELS = ("姓名", "主旨", "日期", "申請人", "統一編號", "Subject", "地址")
_FIELDS = " UNION ALL ".join(
    f"SELECT result_id, '{name}' AS label, {strip_sql(f"regexp_extract(structured_text, '{name}{B}*[:：=]{B}*([^\\n\\r|]{{1,80}})', 1)")} AS value FROM r "
    f"WHERE regexp_matches(structured_text, '{name}{B}*[:：=]{B}*[^\\n\\r|]{{1,80}}')"
    for name in _LABELS
)


@query(f"WITH r AS {RESULTS} {_FIELDS}")
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = X.extract_fields(F.col("structured_text"), list(_LABELS))
    found = results(spark, sf_dir, "structured_text").select("result_id", F.explode(fields).alias("label", "value"))
    return found.dropDuplicates(["result_id", "label"])


# ---- validators -----------------------------------------------------------------------------------

_KEY = "o_orderkey"


def _tw_id(k: Column) -> Column:
    return F.concat(F.char(65 + k % 26), (1 + k % 2).cast("string"), F.lpad(((k * 7919) % 100000000).cast("string"), 8, "0"))


def _company(k: Column) -> Column:
    return F.lpad(((k * 104729) % 100000000).cast("string"), 8, "0")


def _card(k: Column) -> Column:
    return F.concat(F.lit("4"), F.lpad(((k * 15485863) % 1000000000000000).cast("string"), 15, "0"))


def _mobile(k: Column) -> Column:
    return F.concat(F.lit("09"), F.lpad((k % 100000000).cast("string"), 8, "0"))


@query(f"""WITH c AS (SELECT o_orderkey, {TW_ID_SQL.format(_KEY)} AS value FROM orders)
    SELECT o_orderkey, value, {id_ok_sql("value")} AS valid FROM c""")
def validate_tw_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select(_KEY, _tw_id(F.col(_KEY)).alias("value"))
    return made.withColumn("valid", V.identity_number(F.col("value")))


@query(f"""WITH c AS (SELECT o_orderkey, {COMPANY_SQL.format(_KEY)} AS value FROM orders)
    SELECT o_orderkey, value, {company_ok_sql("value")} AS valid FROM c""")
def validate_company_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "orders").select(_KEY, _company(F.col(_KEY)).alias("value"))
    return made.withColumn("valid", V.company_number(F.col("value")))


@query(f"""WITH c AS (SELECT o_orderkey, {CARD_SQL.format(_KEY)} AS value FROM orders)
    SELECT o_orderkey, substr(value, 1, 4) || '-' || substr(value, 5) AS value, {luhn_ok_sql("value")} AS valid FROM c""")
def validate_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = _card(F.col(_KEY))
    made = table(spark, sf_dir, "orders").select(_KEY, F.concat(F.substring(card, 1, 4), F.lit("-"), F.substring(card, 5, 12)).alias("value"))
    return made.withColumn("valid", V.luhn(F.col("value")))


# ---- detection ------------------------------------------------------------------------------------

RULES = {r.entity: r for r in pii.BUILTIN_RULES}


def bare(entity: str) -> pii.PiiRule:
    """A rule without its context words, so that whole texts have an oracle."""
    r = RULES[entity]
    return pii.PiiRule(r.entity, r.label, r.regex, r.score, r.validator)


def _counts(spark: SparkSession, sf_dir: str, rule: pii.PiiRule) -> DataFrame:
    """Findings of one rule in each result, as their number and the hash of their texts."""
    found = results(spark, sf_dir, "structured_text").select("result_id", pii.rule_matches(F.coalesce("structured_text", F.lit("")), rule, 0).alias("f"))
    counted = found.select("result_id", F.size("f").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("f", lambda f: f["text"]), "|")).alias("found"))
    return counted.dropDuplicates(["result_id"])


def _counts_sql(found: str) -> str:
    return f"WITH m AS (SELECT result_id, {found} AS f FROM (SELECT result_id, coalesce(structured_text, '') AS text FROM {RESULTS})) SELECT result_id, CAST(len(f) AS BIGINT) AS n, md5(coalesce(array_to_string(f, '|'), '')) AS found FROM m"


EMAIL_RX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(_counts_sql(f"regexp_extract_all(text, '{EMAIL_RX}')"))
def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, bare("EMAIL"))


@query(_counts_sql(r"list_filter(regexp_extract_all(text, '\p{Nd}+'), lambda s: length(s) BETWEEN 10 AND 16)"))
def detect_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, bare("BANK_ACCOUNT"))


@query(_counts_sql(rf"list_filter(regexp_extract_all(text, '\p{{Nd}}+'), lambda s: length(s) = 8 AND {company_ok_sql("s")})"))
def detect_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, bare("TW_COMPANY_ID"))


_ID_TOKENS = "list_transform(list_filter(regexp_extract_all(text, '[A-Z0-9]+'), lambda s: regexp_matches(s, '^[A-Z][12][0-9]{8}([^0-9]|$)')), lambda s: substr(s, 1, 10))"
_ID_FOUND = f"list_filter({_ID_TOKENS}, lambda s: {id_sum_sql('s')} % 10 = 0)"


@query(_counts_sql(_ID_FOUND))
def detect_tw_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, bare("TW_ID_NUMBER"))


@query(_counts_sql("list_transform(list_filter(regexp_extract_all(text, '[A-Z0-9]+'), lambda s: regexp_matches(s, '^([0-9]{9}|[A-Z]{1,2}[0-9]{7,8})([^0-9]|$)')), lambda s: regexp_extract(s, '^([0-9]{9}|[A-Z]{1,2}[0-9]{7,8})', 1))"))
def detect_passport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, bare("PASSPORT"))


def _injected(spark: SparkSession, sf_dir: str, *parts: Column) -> DataFrame:
    """doc_id and a text made from its key, the same in the oracle."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))


def _findings(df: DataFrame, rules: tuple[pii.PiiRule, ...]) -> DataFrame:
    found = df.select("doc_id", F.explode(pii.detect(F.col("text"), rules)).alias("f")).select("doc_id", "f.*")
    return found.select("doc_id", "entity", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"), F.col("text").alias("found"))


@query(f"""WITH c AS (SELECT doc_id, {CARD_SQL.format("doc_id")} AS card FROM documents)
    SELECT doc_id, 'CREDIT_CARD' AS entity, CAST(5 AS BIGINT) AS start_pos, CAST(24 AS BIGINT) AS end_pos,
        substr(card, 1, 4) || ' ' || substr(card, 5, 4) || ' ' || substr(card, 9, 4) || ' ' || substr(card, 13, 4) AS found FROM c
    WHERE {luhn_ok_sql("card")} AND doc_id % 3 <> 1""")
def detect_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = _card(F.col("doc_id"))
    grouped = F.concat_ws(" ", *[F.substring(card, i, 4) for i in (1, 5, 9, 13)])
    lead = F.when(F.col("doc_id") % 3 == 1, F.lit("流水號碼 ")).otherwise(F.lit("信用卡號 "))
    return _findings(_injected(spark, sf_dir, lead, grouped, F.lit(" 完")), (RULES["CREDIT_CARD"],))


@query(f"""WITH c AS (SELECT doc_id, {MOBILE_SQL.format("doc_id")} AS m FROM documents)
    SELECT doc_id, 'TW_MOBILE' AS entity, CAST(3 AS BIGINT) AS start_pos, CAST(CASE WHEN doc_id % 2 = 0 THEN 15 ELSE 13 END AS BIGINT) AS end_pos,
        CASE WHEN doc_id % 2 = 0 THEN substr(m, 1, 4) || '-' || substr(m, 5, 3) || '-' || substr(m, 8, 3) ELSE m END AS found FROM c""")
def detect_mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mobile(F.col("doc_id"))
    shown = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("-", F.substring(m, 1, 4), F.substring(m, 5, 3), F.substring(m, 8, 3))).otherwise(m)
    return _findings(_injected(spark, sf_dir, F.lit("手機："), shown, F.lit("。9")), (RULES["TW_MOBILE"],))


@query("""SELECT doc_id, 'TW_LANDLINE' AS entity, CAST(3 AS BIGINT) AS start_pos, CAST(16 AS BIGINT) AS end_pos,
        '(02)' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST((doc_id * 7) % 10000 AS VARCHAR), 4, '0') AS found
    FROM documents WHERE doc_id % 3 = 0""")
def detect_landline(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    lead = F.when(k % 3 == 0, F.lit("電話 ")).when(k % 3 == 1, F.lit("編號 ")).otherwise(F.concat(F.lit("電話"), F.repeat(F.lit("無"), 30), F.lit("關 ")))
    number = F.concat(F.lit("(02)"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad(((k * 7) % 10000).cast("string"), 4, "0"))
    return _findings(_injected(spark, sf_dir, lead, number, F.lit(" 止")), (RULES["TW_LANDLINE"],))


@query("""
    SELECT doc_id, 'NHI_CARD' AS entity, CAST(3 AS BIGINT) AS start_pos, CAST(15 AS BIGINT) AS end_pos, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS found FROM documents
    UNION ALL SELECT doc_id, 'TW_RESIDENT_ID', CAST(20 AS BIGINT), CAST(30 AS BIGINT), 'A8' || lpad(CAST(doc_id % 100000000 AS VARCHAR), 8, '0') FROM documents
    UNION ALL SELECT doc_id, 'VEHICLE_PLATE', CAST(34 AS BIGINT), CAST(42 AS BIGINT), 'ABC-' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') FROM documents""")
def detect_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    made = _injected(
        spark, sf_dir, F.lit("健保 "), F.lpad(k.cast("string"), 12, "0"), F.lit("；居留證 A8"), F.lpad((k % 100000000).cast("string"), 8, "0"),
        F.lit("；車號 ABC-"), F.lpad((k % 10000).cast("string"), 4, "0"),
    )
    return _findings(made, pii.rules_from_yaml(pii.SHIPPED_YAML))


@query(f"""WITH c AS (SELECT doc_id, {MOBILE_SQL.format("doc_id")} AS m FROM documents)
    SELECT doc_id, 'TW_MOBILE' AS entity, CAST(8 AS BIGINT) AS start_pos, CAST(18 AS BIGINT) AS end_pos, m AS found FROM c
    UNION ALL SELECT doc_id, 'BANK_ACCOUNT', CAST(22 AS BIGINT), CAST(33 AS BIGINT), m || '7' FROM c""")
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mobile(F.col("doc_id"))
    made = _injected(spark, sf_dir, F.lit("帳號轉帳用手機 "), m, F.lit(" 及帳號"), m, F.lit("7 認證"))
    return _findings(made, pii.BUILTIN_RULES)


def _masked(spark: SparkSession, sf_dir: str, operator: str) -> DataFrame:
    rows = pii.with_findings(results(spark, sf_dir, "structured_text"), "structured_text", (RULES["EMAIL"],))
    return rows.select("result_id", F.md5(pii.mask(F.col("structured_text"), F.col("findings"), operator)).alias("masked")).dropDuplicates(["result_id"])


@query(f"SELECT result_id, md5(regexp_replace(structured_text, '{EMAIL_RX}', '《電子郵件》', 'g')) AS masked FROM {RESULTS}")
def mask_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "replace")


@query(f"SELECT result_id, md5(regexp_replace(structured_text, '{EMAIL_RX}', '', 'g')) AS masked FROM {RESULTS}")
def mask_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "redact")


@query(f"SELECT result_id, md5(structured_text) AS masked FROM {RESULTS}")
def mask_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "keep")


@query(f"""WITH c AS (SELECT doc_id, {MOBILE_SQL.format("doc_id")} AS m FROM documents)
    SELECT doc_id, '手機《手機號碼#' || substr(sha256(m), 1, 8) || '》，再撥《手機號碼#' || substr(sha256('0911-222-333'), 1, 8) || '》。' AS masked FROM c""")
def mask_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _injected(spark, sf_dir, F.lit("手機"), _mobile(F.col("doc_id")), F.lit("，再撥0911-222-333。"))
    found = pii.with_findings(made, "text", (RULES["TW_MOBILE"],))
    return found.select("doc_id", pii.mask(F.col("text"), F.col("findings"), "hash").alias("masked"))


_REPORT_RULES = ("EMAIL", "TW_ID_NUMBER")


_TEXTS = f"(SELECT doc_type, structured_text AS text FROM {RESULTS} WHERE structured_text IS NOT NULL)"


@query(f"""WITH m AS (SELECT doc_type, len(regexp_extract_all(text, '{EMAIL_RX}')) AS e, len({_ID_FOUND}) AS i FROM {_TEXTS})
    SELECT doc_type, CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (e + i > 0) AS BIGINT) AS affected, CAST(sum(e + i) AS BIGINT) AS findings, CAST(count(*) FILTER (e > 0 AND i > 0) AS BIGINT) AS both_types
    FROM m GROUP BY 1""")
def pii_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir, "doc_type", "structured_text").filter("structured_text is not null")
    report = pii.analyze_and_mask(rows, "structured_text", "replace", tuple(RULES[e] for e in _REPORT_RULES))
    counted = report.select("result_id", "doc_type", "pii_report.pii_count", "pii_report.pii_types").dropDuplicates(["result_id"])
    return counted.groupBy("doc_type").agg(
        F.count("*").alias("documents"), F.count_if(F.col("pii_count") > 0).alias("affected"),
        F.sum("pii_count").alias("findings"), F.count_if(F.size("pii_types") == 2).alias("both_types"),
    )


@query("""WITH f AS (SELECT * FROM pii_findings QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY loaded_at) = 1)
    SELECT entity, label, CAST(count(*) AS BIGINT) AS findings, CAST(count(DISTINCT result_id) AS BIGINT) AS results, max(score) AS best FROM f GROUP BY 1, 2""")
def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pii_findings").select("finding_id", "result_id", "entity", "label", "score").dropDuplicates(["finding_id"])
    return found.groupBy("entity", "label").agg(F.count("*").alias("findings"), F.countDistinct("result_id").alias("results"), F.max("score").alias("best"))


@query(f"""WITH m AS (SELECT doc_type, unnest(regexp_extract_all(text, '{EMAIL_RX}')) AS t, 'EMAIL' AS entity FROM {_TEXTS}
        UNION ALL SELECT doc_type, unnest({_ID_FOUND}), 'TW_ID_NUMBER' FROM {_TEXTS})
    SELECT doc_type, entity, CAST(count(*) AS BIGINT) AS findings, CAST(count(DISTINCT t) AS BIGINT) AS different FROM m GROUP BY 1, 2""")
def pii_types_by_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.with_findings(results(spark, sf_dir, "doc_type", "structured_text"), "structured_text", tuple(RULES[e] for e in _REPORT_RULES))
    once_each = rows.select("result_id", "doc_type", "findings").dropDuplicates(["result_id"])
    found = once_each.select("doc_type", F.explode("findings").alias("f")).select("doc_type", "f.entity", "f.text")
    return found.groupBy("doc_type", "entity").agg(F.count("*").alias("findings"), F.countDistinct("text").alias("different"))


# ---- comparison -----------------------------------------------------------------------------------


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    following = ids.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"))
    return ids.join(following, ids["doc_id"] == following["a"]).select(F.col("a").alias("pair_id"), "a", "b")


_SQUEEZED = f"regexp_replace(text, '{B}+', '', 'g')"
NGRAM_SQL = f"""
    d AS (SELECT doc_id, {_SQUEEZED} AS t FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, substr(t, CAST(i AS INTEGER), 2) AS gram, count(*) AS n FROM (SELECT doc_id, t, unnest(range(1, length(t))) AS i FROM d) GROUP BY 1, 2),
    n AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM g GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    s AS (SELECT p.a, p.b, sum(x.n * y.n) AS dot FROM p JOIN g x ON x.doc_id = p.a JOIN g y ON y.doc_id = p.b AND y.gram = x.gram GROUP BY 1, 2),
    scored AS (SELECT p.a AS pair_id, p.a, p.b, coalesce(round(s.dot / (na.norm * nb.norm), 4), 0.0) AS score
        FROM p LEFT JOIN s ON s.a = p.a AND s.b = p.b LEFT JOIN n na ON na.doc_id = p.a LEFT JOIN n nb ON nb.doc_id = p.b)"""


@query(f"WITH {NGRAM_SQL} SELECT pair_id, a, b, score FROM scored")
def ngram_by_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational form, for texts that occur in very many pairs."""
    docs = text_rows(spark, sf_dir, "documents", "doc_id", "text")
    return compare.ngram_similarity_by_gram(docs, _neighbours(spark, sf_dir))


@query(f"WITH {NGRAM_SQL} SELECT pair_id, a, b, score FROM scored")
def ngram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_rows(spark, sf_dir, "documents", "doc_id", "text")
    return compare.ngram_similarity(docs, _neighbours(spark, sf_dir))


@query(f"""WITH {NGRAM_SQL} SELECT CASE WHEN score >= 0.9 THEN 'nearly_identical' WHEN score >= 0.7 THEN 'similar' ELSE 'different' END AS band, CAST(count(*) AS BIGINT) AS pairs FROM scored GROUP BY 1""")
def similarity_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_similarity(spark, sf_dir)
    return scored.groupBy(compare.similarity_band(F.col("score")).alias("band")).agg(F.count("*").alias("pairs"))


@query(f"""WITH r AS (SELECT result_id, string_split(structured_text, chr(10)) AS a, string_split(display_text, chr(10)) AS b FROM {RESULTS} WHERE structured_text IS NOT NULL AND display_text IS NOT NULL),
    d AS (SELECT result_id, len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) AS n, len(a) = len(b) AS aligned FROM r)
    SELECT result_id, CAST(n AS INTEGER) AS added, CAST(n AS INTEGER) AS removed FROM d WHERE aligned""")
def text_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added and removed between each result's text and its displayed form, where masking kept the lines."""
    rows = results(spark, sf_dir, "structured_text", "display_text").filter("size(split(structured_text, '\n', -1)) = size(split(display_text, '\n', -1))")
    diff = rows.select("result_id", compare.diff_text(F.col("structured_text"), F.col("display_text")).alias("d"))
    return diff.select("result_id", "d.added", "d.removed").dropDuplicates(["result_id"])


@query()
def text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result's text against its displayed form; the matcher of the standard library has no SQL."""
    rows = results(spark, sf_dir, "structured_text", "display_text").filter("structured_text is not null and display_text is not null")
    diff = rows.select("result_id", compare.diff_text(F.col("structured_text"), F.col("display_text")).alias("d"))
    counted = diff.select("result_id", "d.similarity_ratio", "d.added", "d.removed", F.size(compare.shown_lines(F.col("d"))).alias("shown"))
    return counted.dropDuplicates(["result_id"])


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, k = F.col("c_name"), F.col("c_custkey")
    left = F.create_map(F.lit("name"), name, F.lit("amount"), F.concat(F.lit("NT$ "), F.format_number("c_acctbal", 2), F.lit(" 元")), F.lit("segment"), F.col("c_mktsegment"))
    right = F.create_map(
        F.lit("name"), F.when(k % 3 == 0, F.concat(F.lit("　"), name)).when(k % 3 == 1, F.concat(name, F.lit("x"))).otherwise(F.lit(None)),
        F.lit("amount"), F.when(k % 4 == 0, F.lit("無數字")).otherwise(F.format_string("%.2f", F.col("c_acctbal") + F.when(k % 2 == 0, 1).otherwise(0))),
    )
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pair_id"), left.alias("a"), right.alias("b"))


_FIELD_SQL = """SELECT c_custkey AS pair_id, 'name' AS field, c_custkey % 3 = 0 AS match, CASE WHEN c_custkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM customer
    UNION ALL SELECT c_custkey, 'segment', false, 0.0::DOUBLE FROM customer"""


@query(_FIELD_SQL)
def field_compare_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.field_compare(_maps(spark, sf_dir), "a", "b", {"name": {"type": "exact"}, "segment": {"type": "unknown"}})
    return found.select("pair_id", "field", "match", "score")


@query("""SELECT c_custkey AS pair_id, 'amount' AS field, c_custkey % 2 = 1 AS match, CASE WHEN c_custkey % 2 = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM customer
    UNION ALL SELECT c_custkey, 'absent', false, 0.0::DOUBLE FROM customer""")
def field_compare_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.field_compare(_maps(spark, sf_dir), "a", "b", {"amount": {"type": "numeric"}, "absent": {"type": "numeric"}})
    return found.select("pair_id", "field", "match", "score")


_FUZZY = "CASE c_custkey % 3 WHEN 2 THEN 0.0 ELSE 2.0 * length(c_name) / (2 * length(c_name) + 1) END"


@query(f"SELECT c_custkey AS pair_id, 'name' AS field, {_FUZZY} >= 0.85 AS match, round({_FUZZY}, 3)::DOUBLE AS score FROM customer")
def field_compare_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with one character more, before or after, or none at all: what the matcher's ratio is follows from their lengths."""
    found = compare.field_compare(_maps(spark, sf_dir), "a", "b", {"name": {"type": "fuzzy", "threshold": 0.85}})
    return found.select("pair_id", "field", "match", "score")


_BODY = strip_sql("text")


@query(f"""WITH b AS (SELECT doc_id, {_BODY} AS t FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, t, unnest(range(0, greatest(length(t), 1), 400)) AS s FROM b)
    SELECT doc_id, CAST(s // 400 AS BIGINT) AS chunk_no, md5(substr(t, CAST(s AS INTEGER) + 1, 400)) AS chunk, CAST(length(substr(t, CAST(s AS INTEGER) + 1, 400)) AS BIGINT) AS n_chars FROM c""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = text_rows(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk_no", "c"))
    return pieces.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("c").alias("chunk"), F.length("c").cast("bigint").alias("n_chars"))


@query("""
    WITH p AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2)
    SELECT CAST(a.label AS BIGINT) AS a, CAST(b.label AS BIGINT) AS b, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 4) AS score
    FROM m a JOIN m b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    means = compare.mean_vectors(vectors, "label", "embedding")
    labels = vectors.agg(F.array_sort(F.collect_set("label")).alias("all"))  # labels are few: the classes of the vectors
    pairs = labels.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", lambda x: x > F.col("a"))).alias("b"))
    left, right = means.withColumnsRenamed({"label": "a", "mean": "mean_a"}), means.withColumnsRenamed({"label": "b", "mean": "mean_b"})
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), compare.cosine(F.col("mean_a"), F.col("mean_b")).alias("score"))


# ---- routing --------------------------------------------------------------------------------------

# One file head for each kind, by doc_id; the rest of the file is the key.
_HEADS = (
    ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("49492A00", "image"), ("4D4D002A", "image"), ("424D", "image"), ("474946383961", "image"),
    ("524946460000000057454250", "image"), ("524946460000000041564920", "unknown"), ("0000255044462D", "pdf_digital"), ("D0CF11E0A1B11AE1", "legacy_office"), ("68656C6C6F", "text"), ("00FF", "unknown"),
)


@query("SELECT doc_id, CASE CAST(doc_id % 12 AS INTEGER) " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, kind) in enumerate(_HEADS)) + " END AS doc_type FROM documents")
def route_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*[F.unhex(F.lit(h)) for h, _ in _HEADS])
    tail = F.when(F.col("doc_id") % 12 == 7, F.unhex(F.lit("00"))).otherwise(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    content = F.concat(F.get(heads, (F.col("doc_id") % 12).cast("int")), tail)
    files = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.lit("/in/a.pdf").alias("file"))
    return files.select("doc_id", routing.detect_type(F.col("content"), F.col("file")).alias("doc_type"))


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars > 2000 THEN 'too_large' END AS code,
        CASE WHEN n_chars = 0 THEN '檔案是空的（0 KB）。' WHEN n_chars > 2000 THEN '檔案過大（' || printf('%.1f', n_chars::DOUBLE) || ' MB，上限 2000 MB）。' END AS message
    FROM documents WHERE n_chars IS NOT NULL""")
def validate_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("n_chars is not null")
    checked = docs.select("doc_id", routing.size_error(F.col("n_chars") * F.lit(1024 * 1024), 2000).alias("e"))
    return checked.select("doc_id", "e.code", "e.message")


@query(f"""WITH p AS (SELECT result_id, page, any_value(text) AS text FROM page_extracts GROUP BY 1, 2),
    f AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY page) AS k FROM p),
    c AS (SELECT result_id, avg(CASE WHEN length({_BODY}) >= 50 THEN 1.0 ELSE 0.0 END) AS share FROM f WHERE k <= 30 GROUP BY 1)
    SELECT result_id, CASE WHEN coalesce(share, 0) >= 0.8 THEN 'pdf_digital' WHEN coalesce(share, 0) <= 0.1 THEN 'pdf_scanned' ELSE 'pdf_mixed' END AS kind FROM c""")
def pdf_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_extracts").select("result_id", "page", "text").dropDuplicates(["result_id", "page"])
    pages = rows.groupBy("result_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]).alias("texts"))
    return pages.select("result_id", routing.classify_pdf(F.col("texts")).alias("kind"))


@query("""SELECT c_custkey, '寄件者：' || c_name || ' <c' || c_custkey || '@x.example>' || chr(10) || '收件者：desk@y.example' || chr(10) || '主旨：Order ' || c_custkey || chr(10)
        || '日期：Mon, 01 Jan 2024 08:00:00 +0800' || chr(10) || chr(10) || 'Balance ' || c_mktsegment || chr(10) AS text FROM customer""")
def read_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails written from the customers' rows, routed and read again."""
    key = F.col("c_custkey").cast("string")
    mail = F.concat(
        F.lit("From: "), F.col("c_name"), F.lit(" <c"), key, F.lit("@x.example>\nTo: desk@y.example\nSubject: Order "), key,
        F.lit("\nDate: Mon, 1 Jan 2024 08:00:00 +0800\nMIME-Version: 1.0\n\nBalance "), F.col("c_mktsegment"), F.lit("\n"),
    )
    none = F.lit(None).cast("string")
    files = text_rows(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select(
        F.concat(F.lit("/in/"), key, F.lit(".txt")).alias("file"), key.alias("file_name"), F.col("c_custkey").alias("ord"), F.encode(mail, "UTF-8").alias("content"), none.alias("error_code"), none.alias("error")
    )
    read = extract(route(files), DEFAULTS).filter("error_code is null and raw.type = 'email'")
    return read.select(F.col("ord").alias("c_custkey"), F.col("raw.text").alias("text"))


@query(f"""SELECT doc_id, CASE WHEN text = '' THEN 'failed' ELSE 'success' END AS status, CASE WHEN text = '' THEN NULL ELSE 'text' END AS doc_type,
        CASE WHEN text = '' THEN NULL ELSE md5({clean_sql("ltrim(text, chr(65279))")}) END AS structured, CASE WHEN text = '' THEN '檔案是空的（0 KB）。' ELSE '' END AS error FROM documents WHERE text IS NOT NULL""")
def process_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: checked, routed, decoded, structured and protected."""
    empty = F.lit(None).cast("string")
    docs = text_rows(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    content = F.encode("text", "UTF-8")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    files = docs.select(
        F.concat(F.lit("/in/"), name).alias("file"), name.alias("file_name"), F.col("doc_id").alias("ord"), F.octet_length("text").cast("bigint").alias("length"), content.alias("content"),
        F.when(F.col("text") == "", "empty").otherwise(empty).alias("error_code"), F.when(F.col("text") == "", MESSAGES["empty"]).otherwise(empty).alias("error"),
    )
    rows = results_of(files, readers={"text": read_text})
    return rows.select(F.col("ord").alias("doc_id"), "status", "doc_type", F.md5("structured_text").alias("structured"), "error")


@query()
def image_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drawn page for each nation, tilted by its key, prepared for recognition; tests check each step."""
    import pandas as pd

    def run(batches):
        import numpy as np

        from ..operators import images

        for rows in batches:
            for key in rows["n_nationkey"]:
                page = np.full((80, 120), 245, np.uint8)
                page[16:64:8, 12:108] = 15
                tilted = images.rotate(page, (key % 9) - 4)
                ready = images.prepare(tilted)
                yield pd.DataFrame({"n_nationkey": [key], "skew": [round(images.skew_angle(tilted), 1)], "left": [round(images.skew_angle(ready), 1)], "black": [int((ready == 0).sum())]})

    return table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(run, "n_nationkey int, skew double, left double, black bigint")


@query()
def field_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled fields of each result's text against those of its displayed form: how many still agree."""
    rows = results(spark, sf_dir, "structured_text", "display_text").filter("structured_text is not null")
    compared = compare.field_mode(rows, "structured_text", "display_text", list(_LABELS)).dropDuplicates(["result_id", "field"])
    return compare.match_share(compared, "field")


# ---- batches --------------------------------------------------------------------------------------


@query(f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'success') AS BIGINT) AS success, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed,
        CAST(count(*) FILTER (status = 'skipped') AS BIGINT) AS skipped, coalesce(round(avg(duration_sec), 1), 0.0) AS avg_sec FROM {RESULTS}""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.summary(once(spark, sf_dir, "status", "duration_sec"))


@query(f"""SELECT r.batch_id, b.unit_code, CAST(count(*) AS BIGINT) AS results, CAST(count(*) FILTER (r.status <> 'success') AS BIGINT) AS not_done, CAST(sum(r.pages) AS BIGINT) AS pages
    FROM {RESULTS} r LEFT JOIN batches b USING (batch_id) GROUP BY 1, 2""")
def batches_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = once(spark, sf_dir, "batch_id", "status", "pages").groupBy("batch_id").agg(
        F.count("*").alias("results"), F.count_if(F.col("status") != "success").alias("not_done"), F.sum("pages").alias("pages")
    )
    units = table(spark, sf_dir, "batches").select("batch_id", "unit_code")
    return counted.join(units, "batch_id", "left").select("batch_id", "unit_code", "results", "not_done", "pages")


@query(f"""SELECT result_id, '| ' || regexp_extract(file, '[^/\\\\]*$') || ' | ' || CASE status WHEN 'success' THEN '✅ 成功' WHEN 'failed' THEN '❌ 失敗' WHEN 'skipped' THEN '⏭️ 跳過' ELSE '' END
        || ' | ' || coalesce(CAST(duration_sec AS VARCHAR), '0.0') || ' | ' || coalesce(CAST(pii_report.pii_count AS VARCHAR), '') || ' | ' || coalesce(error, '') || ' |' AS line FROM {RESULTS}""")
def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = once(spark, sf_dir, "file", "status", "duration_sec", "pii_report", "error").withColumn("ord", F.col("result_id"))
    return batch.detail_lines(rows).select(F.col("ord").alias("result_id"), "line")


@query(f"""SELECT date_trunc('hour', processed_at) AS window_start, status, CAST(count(*) AS BIGINT) AS results, round(avg(duration_sec), 6) AS avg_sec FROM {RESULTS} WHERE processed_at IS NOT NULL GROUP BY 1, 2""")
def results_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = status_windows(once(spark, sf_dir, "processed_at", "status", "duration_sec"))
    return hours.withColumn("avg_sec", F.round("avg_sec", 6))


@query(f"""SELECT date_trunc('hour', processed_at) AS window_start, status, CAST(count(*) AS BIGINT) AS results, round(avg(duration_sec), 6) AS avg_sec FROM doc_results WHERE processed_at IS NOT NULL GROUP BY 1, 2""")
def stream_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the table (a pattern, since it may be a file or a folder of them): windows kept up to date; every delivery counts."""
    columns = table(spark, sf_dir, "doc_results").select("result_id", "processed_at", "status", "duration_sec")
    stream = spark.readStream.schema(columns.schema).parquet(f"{sf_dir}/doc_results.[p]arquet").filter("processed_at is not null")
    stream = stream.withColumn("processed_at", F.col("processed_at").cast("timestamp"))  # watermarks ask for it
    hours = status_windows(stream, late="3650 days")
    out = scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/hours")

    run = hours.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/hours").withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "avg_sec": F.round("avg_sec", 6)})


# ---- audit ----------------------------------------------------------------------------------------

_LINES = "(SELECT log_name, line_no, any_value(raw) AS raw FROM audit_lines GROUP BY 1, 2)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audit_lines").select("log_name", "line_no", "raw").dropDuplicates(["log_name", "line_no"])


@query(f"""WITH l AS (SELECT log_name, line_no, CASE WHEN json_valid(raw) THEN raw END AS raw FROM {_LINES} WHERE trim(raw) <> ''),
    h AS (SELECT log_name, line_no, raw IS NULL AS broken, raw ->> '$.prev_hash' AS prev, raw ->> '$.entry_hash' AS claimed FROM l),
    e AS (SELECT *, lag(claimed) OVER w AS expected, row_number() OVER w AS k FROM h WINDOW w AS (PARTITION BY log_name ORDER BY line_no))
    SELECT log_name, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (broken OR prev IS DISTINCT FROM CASE WHEN k = 1 THEN repeat('0', 64) ELSE expected END) AS BIGINT) AS broken_links FROM e GROUP BY 1""")
def audit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    faults = audit.chain_faults(lines).groupBy("log_name").agg(F.count_if(F.col("fault").isin("json", "link")).alias("broken"))
    totals = lines.filter("trim(raw) <> ''").groupBy("log_name").agg(F.count("*").alias("lines"))
    return totals.join(faults, "log_name", "left").select("log_name", "lines", F.coalesce("broken", F.lit(0)).cast("bigint").alias("broken_links"))


_VALUE = """replace(json_extract(raw, '$."' || k || '"')::VARCHAR, '","', '", "')"""
_KEYS = "list_sort(list_filter(json_keys(raw), lambda k: k NOT IN ('prev_hash', 'entry_hash')))"


def _verify_sql(lines: str) -> str:
    return f"""l AS (SELECT log_name, line_no, CASE WHEN json_valid(raw) THEN raw END AS raw FROM {lines} WHERE trim(raw) <> ''),
    h AS (SELECT log_name, line_no, raw, raw ->> '$.prev_hash' AS prev, raw ->> '$.entry_hash' AS claimed,
        '{{' || array_to_string(list_transform({_KEYS}, lambda k: '"' || k || '": ' || {_VALUE}), ', ') || '}}' AS body FROM l),
    e AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN repeat('0', 64) ELSE lag(claimed) OVER w END AS expected FROM h WINDOW w AS (PARTITION BY log_name ORDER BY line_no)),
    f AS (SELECT log_name, line_no, CASE WHEN raw IS NULL THEN 'json' WHEN prev IS DISTINCT FROM expected THEN 'link' WHEN sha256(coalesce(expected, '') || body) IS DISTINCT FROM claimed THEN 'hash' END AS fault FROM e),
    first AS (SELECT log_name, min(line_no) AS fault_line, arg_min(fault, line_no) AS fault FROM f WHERE fault IS NOT NULL GROUP BY 1),
    n AS (SELECT log_name, CAST(count(*) AS BIGINT) AS lines FROM {lines} GROUP BY 1)
    SELECT n.log_name, fault IS NULL AS ok, lines, coalesce(fault_line, 0) AS fault_line, fault, CASE fault WHEN 'json' THEN '第 ' || fault_line || ' 行不是合法 JSON（可能被竄改）' WHEN 'link' THEN '第 ' || fault_line || ' 行 prev_hash 斷鏈（前面有記錄被刪除或修改）'
        WHEN 'hash' THEN '第 ' || fault_line || ' 行內容與雜湊不符（該行被竄改）' ELSE '稽核日誌完整無竄改' END AS verdict FROM n LEFT JOIN first USING (log_name)"""


def _verified(lines: DataFrame) -> DataFrame:
    found = audit.verify_chains(lines)
    return found.withColumn("verdict", audit.verdict(F.col("fault"), F.col("fault_line"))).na.fill(0, ["fault_line"])


@query("WITH " + _verify_sql(_LINES))
def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fault of each log: broken JSON, broken link or wrong hash of the canonical form."""
    return _verified(_lines(spark, sf_dir))


_TAMPER = "CASE WHEN way = 'altered' AND line_no % 997 = 40 THEN replace(raw, '\"event\": \"', '\"event\": \"x') WHEN way = 'torn' AND line_no = 30 THEN substr(raw, 1, 20) WHEN way = 'blank' AND line_no % 3 = 0 THEN raw || '  ' ELSE raw END"
_WAYS = ("altered", "torn", "cut", "headless", "blank")
_KEPT = "NOT (way = 'cut' AND line_no = 50) AND NOT (way = 'headless' AND line_no = 1)"


@query(f"""WITH t AS (SELECT log_name || '/' || way AS log_name, line_no, {_TAMPER} AS raw FROM {_LINES}, (SELECT unnest({list(_WAYS)}) AS way) WHERE {_KEPT}),
    """ + _verify_sql("t"))
def audit_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every log once for each way of tampering with it, verified: an altered line, a torn one, a deleted one, no first one, blanks at the end."""
    ways = F.explode(F.array(*map(F.lit, _WAYS))).alias("way")
    lines = _lines(spark, sf_dir).select("log_name", "line_no", "raw", ways).filter(_KEPT)
    return _verified(lines.select(F.concat("log_name", F.lit("/"), "way").alias("log_name"), "line_no", F.expr(_TAMPER).alias("raw")))


@query(f"""SELECT 'pii_scan' AS event, file_name AS file, CAST(count(*) AS BIGINT) AS n, CAST(sum(pii_report.pii_count) AS BIGINT) AS total FROM {RESULTS} WHERE status = 'success' GROUP BY 2
    UNION ALL SELECT 'process', file_name, CAST(count(*) AS BIGINT), CAST(sum(length(structured_text)) AS BIGINT) FROM {RESULTS} WHERE status = 'success' GROUP BY 2""")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir, "ord", "status", "file_name", "doc_type", "structured_text", "pii_report").withColumn("ord", F.col("result_id"))
    made = audit.scan_events(rows, "replace").unionByName(audit.process_events(rows, True), allowMissingColumns=True).dropDuplicates(["ord", "event"])
    amount = F.when(F.col("event") == "pii_scan", F.col("pii_count")).otherwise(F.col("chars"))
    return made.groupBy("event", "file").agg(F.count("*").alias("n"), F.sum(amount).alias("total"))


@query("""SELECT o_orderkey, sha256(sha256(o_orderkey::VARCHAR) || '{"event": "訂單", "key": ' || o_orderkey || ', "state": ["' || o_orderstatus || '", null]}') AS entry_hash FROM orders""")
def audit_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of lines whose keys are in another order and whose blanks are others than the canonical ones."""
    raw = F.format_string('{"state":["%s" ,null], "prev_hash":"x","key":  %d,"event":"\\u8a02單","entry_hash": "y"}', F.col("o_orderstatus"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", audit.line_hash(F.sha2(F.col("o_orderkey").cast("string"), 256), raw).alias("entry_hash"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY result_id ORDER BY loaded_at DESC) AS k FROM doc_results)
    SELECT result_id, loaded_at, CAST(date_diff('day', processed_at::DATE, loaded_at::DATE) AS BIGINT) AS days_late FROM d WHERE k = 1""")
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "doc_results").groupBy("result_id").agg(F.max(F.struct("loaded_at", "processed_at")).alias("r"))
    return newest.select("result_id", "r.loaded_at", F.datediff("r.loaded_at", "r.processed_at").cast("bigint").alias("days_late"))


"""The queries of this subpackage and their SQL, merged into the registry by the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table, text_rows
from .garble import garbled_ids, repair_encoding
from .lookalike import consistent_spelling, misspelled_ids
from .mixture import mixture, shard_report, shares_reached
from .neardup import near_duplicate_classes, near_duplicate_links, near_duplicate_pairs
from .personal import masked_data, personal_data
from .scans import scanned_noise, scanned_text
from .subjects import document_subjects
from .tokenizer import encode_ids

TEXT_FIELDS = ["structured_text", "display_text"]


def _results(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return text_rows(spark, sf_dir, "doc_results", "result_id", *columns)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of results with nearly the same structured or display text."""
    return near_duplicate_pairs(_results(spark, sf_dir, *TEXT_FIELDS), "result_id", TEXT_FIELDS)


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of copies and number of links of every result field."""
    return near_duplicate_classes(_results(spark, sf_dir, *TEXT_FIELDS), "result_id", TEXT_FIELDS)


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts nearly the same, by their classes, with their alikeness."""
    return near_duplicate_links(_results(spark, sf_dir, *TEXT_FIELDS), "result_id", TEXT_FIELDS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results spelled with characters other than the ordinary ones."""
    return misspelled_ids(_results(spark, sf_dir, "structured_text"), "result_id", "structured_text")


def p2_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent spelling of the results that needed one."""
    return consistent_spelling(_results(spark, sf_dir, "structured_text"), "result_id", "structured_text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with a passage decoded with the wrong encoding."""
    return garbled_ids(_results(spark, sf_dir, "structured_text"), "result_id", "structured_text")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected results with their text restored where possible."""
    found = repair_encoding(_results(spark, sf_dir, "structured_text"), "result_id", "structured_text")
    return found.filter("affected").select("result_id", "restored", "lost").dropDuplicates(["result_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in both texts of the results and in the detector's snippets."""
    return personal_data(_results(spark, sf_dir, *TEXT_FIELDS), text_rows(spark, sf_dir, "pii_findings", "finding_id", "entity", "text"))


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of the results and the detector's snippets with typed placeholders."""
    return masked_data(_results(spark, sf_dir, *TEXT_FIELDS), text_rows(spark, sf_dir, "pii_findings", "finding_id", "entity", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise of the page in each scanned result."""
    return scanned_noise(_results(spark, sf_dir, "structured_text", "doc_type"), "result_id", "structured_text", "doc_type")


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanned results as continuous paragraphs."""
    return scanned_text(_results(spark, sf_dir, "structured_text", "doc_type"), "result_id", "structured_text", "doc_type").dropDuplicates(["result_id"])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_ids(text_rows(spark, sf_dir, "documents", "doc_id", "text"), "text", ["doc_id"])


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the named sources in shuffled shards."""
    return mixture(text_rows(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the sources of the mixture really reach."""
    return shares_reached(text_rows(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def p7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each shard of the mixture was drawn to hold of each source, and holds."""
    return shard_report(text_rows(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "mix_targets"))


def _p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = text_rows(spark, sf_dir, "documents", "doc_id", "text")
    samples, areas = table(spark, sf_dir, "subject_samples"), table(spark, sf_dir, "subject_areas")
    return document_subjects(documents, "doc_id", "text", samples, areas)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document."""
    return _p8(spark, sf_dir).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences of the corpus by subject."""
    from pyspark.sql import functions as F

    return _p8(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("about").alias("sentences"))


QUERIES = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p1_links": p1_links,
    "p2_found": p2_found,
    "p2_spelling": p2_spelling,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_masked": p4_masked,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_shards": p7_shards,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}

# ---- SQL for what SQL can express on whole tables --------------------------------------------------

_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SQUEEZED = f"""r AS (SELECT result_id, any_value(structured_text) AS a, any_value(display_text) AS b FROM doc_results WHERE result_id IS NOT NULL GROUP BY 1),
    f AS (SELECT result_id, 0 AS field, regexp_replace(a, '{_BLANK}', '', 'g') AS t FROM r UNION ALL SELECT result_id, 1, regexp_replace(b, '{_BLANK}', '', 'g') FROM r),
    k AS (SELECT result_id, field, t, min(result_id * 2 + field) OVER (PARTITION BY t) AS class_id FROM f WHERE length(t) >= 5),
    x AS (SELECT DISTINCT class_id, t FROM k),
    g AS (SELECT DISTINCT class_id, substr(t, CAST(i AS INTEGER), 5) AS gram FROM (SELECT class_id, t, unnest(range(1, length(t) - 3)) AS i FROM x)),
    n AS (SELECT class_id, count(*) AS n FROM g GROUP BY 1),
    c AS (SELECT p.class_id AS a, q.class_id AS b, count(*) AS c FROM g p JOIN g q ON p.gram = q.gram AND p.class_id < q.class_id GROUP BY 1, 2),
    links AS (SELECT a, b, c / (na.n + nb.n - c) AS alike FROM c JOIN n na ON na.class_id = a JOIN n nb ON nb.class_id = b WHERE c * 10 >= 7 * (na.n + nb.n - c))"""

ORACLES: dict[str, str] = {
    "p1_found": f"""WITH {_SQUEEZED}, same AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links UNION ALL SELECT class_id, class_id FROM x)
        SELECT CASE p.field WHEN 0 THEN 'structured_text' ELSE 'display_text' END AS field_name, p.result_id AS result_a, q.result_id AS result_b
        FROM same JOIN k p ON p.class_id = same.a JOIN k q ON q.class_id = same.b AND q.field = p.field AND p.result_id < q.result_id""",
    "p1_classes": f"""WITH {_SQUEEZED}, d AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY 1)
        SELECT CASE field WHEN 0 THEN 'structured_text' ELSE 'display_text' END AS field, result_id AS row_id, k.class_id, count(*) OVER (PARTITION BY k.class_id, field) AS copies,
            CAST(coalesce(d.links, 0) AS BIGINT) AS links FROM k LEFT JOIN d ON d.id = k.class_id""",
    "p1_links": f"WITH {_SQUEEZED} SELECT a AS class_a, b AS class_b, round(alike, 6) AS alike FROM links",
}

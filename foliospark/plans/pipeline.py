"""From files to canonical results: check, route, read, structure, protect."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators.audit import AuditLog, events
from ..operators.pii import PiiRule, all_rules, analyze_and_mask
from ..operators.routing import detect_type
from ..operators.structure import structure
from ..session import cut_lineage, ship_package
from ..sources.extract import extract
from ..sources.manifest import manifest, with_content

#: Columns of a result row, in order.
RESULT = (
    "file", "file_name", "ord", "doc_type", "structured_text", "display_text", "pii_report", "pages", "used_ocr", "status", "error", "error_detail", "duration_sec", "retries",
)
OCR_TYPES = ("pdf_scanned", "pdf_mixed", "image")


def route(files: DataFrame, strict: bool = False) -> DataFrame:
    """Adds doc_type from the content of files without an error; no content is a corrupted file."""
    kind = F.when(F.col("content").isNull(), F.lit("corrupted")).otherwise(detect_type(F.col("content"), F.col("file"), strict))
    return files.withColumn("doc_type", F.when(F.col("error_code").isNull(), kind))


def protect(results: DataFrame, mask: bool = True, operator: str = "replace", rules: tuple[PiiRule, ...] | None = None) -> DataFrame:
    """Adds pii_report and display_text to rows with structured_text. The report's text is masked in any case."""
    found = analyze_and_mask(results, "structured_text", operator, all_rules() if rules is None else rules).drop("findings")
    report = F.when(F.col("structured_text").isNotNull(), F.col("pii_report"))
    return found.withColumn("pii_report", report).withColumn("display_text", F.col("pii_report.masked_text") if mask else F.col("structured_text"))


def results_of(files: DataFrame, settings: dict | None = None, mask: bool | None = None, operator: str | None = None, readers: dict | None = None, rules=None) -> DataFrame:
    """Canonical results of files with file, file_name, ord, length, content, error_code, error.

    Without ``rules`` the built-in ones apply and those of ``paths.pii_rules`` in the settings: a YAML file,
    ``shipped`` for the rules that come with the package, or nothing.
    """
    settings = settings or DEFAULTS
    rules = all_rules(settings["paths"].get("pii_rules")) if rules is None else rules
    mask = settings["pii"]["default_mask"] if mask is None else mask
    operator = operator or settings["pii"]["operator"]
    read = extract(route(files), settings, readers)
    code = F.col("error_code")
    status = F.when(code.isNull(), "success").when(code == "out_of_memory", "skipped").otherwise("failed")
    pages = F.col("raw.pages")
    rows = read.select(
        "file", "file_name", "ord", "doc_type", F.when(code.isNull(), structure(F.col("raw"))).alias("structured_text"), status.alias("status"),
        F.coalesce("error", F.lit("")).alias("error"), F.coalesce("error_detail", F.lit("")).alias("error_detail"),
        F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"), F.coalesce("retries", F.lit(0)).alias("retries"),
        F.when(F.coalesce(F.size(pages), F.lit(0)) > 0, F.size(pages)).otherwise(1).alias("pages"),
        (F.coalesce(F.col("doc_type").isin(*OCR_TYPES), F.lit(False)) | F.coalesce(F.exists(pages, lambda p: F.coalesce(p["ocr"], F.lit(False))), F.lit(False))).alias("used_ocr"),
    )
    return protect(rows, mask, operator, rules).select(*RESULT)


def process_path(spark: SparkSession, path: str | Path, settings: dict | None = None, audit_log: str | Path | None = None, **options) -> DataFrame:
    """Results of a file or folder on any storage that all executors reach; ``ord`` follows the order of the paths.

    With ``audit_log`` the results are written once and their events appended to that log, in order, by its one
    writer, the driver.
    """
    ship_package(spark)
    settings = settings or DEFAULTS
    results = results_of(with_content(manifest(spark, path), settings["limits"]["max_file_size_mb"]), settings, **options)
    if audit_log is None:
        return results
    results = cut_lineage(results)
    operator, mask = options.get("operator") or settings["pii"]["operator"], options.get("mask")
    AuditLog(audit_log).write_events(events(results, operator, settings["pii"]["default_mask"] if mask is None else mask))
    return results

"""Command line: process, compare, verify-audit, doctor."""

from __future__ import annotations

import argparse
import importlib.util
import sys
from pathlib import Path

from .config import load_settings
from .operators import audit, batch, compare
from .session import cut_lineage, ensure_checkpoint_dir, local_session


def process(args: argparse.Namespace) -> int:
    """Exit code 0, 1 without files, 2 if any file failed."""
    from .plans.pipeline import process_path
    from .sources.sinks import join_parts, write_csv, write_lines, write_markdown

    settings, out = load_settings(args.settings), Path(args.out)
    spark = local_session("*")
    ensure_checkpoint_dir(spark)
    log = Path(settings["paths"]["logs"]) / "audit.jsonl" if settings["pii"]["audit_enabled"] else None
    results = cut_lineage(process_path(spark, args.path, settings, log, mask=not args.no_mask))
    total = batch.summary(results).first()
    if not total["total"]:
        print("找不到可處理的檔案。")
        return 1
    write_markdown(results, out, args.path)
    write_lines(batch.report_lines(results), str(out / "report_parts"))
    join_parts(out / "report_parts", out / "report.md")
    if batch.report_xlsx(results, str(out / "report.xlsx")) is None:
        write_csv(batch.report_table(results), str(out / "report_csv"))
    with open(out / "report.md", encoding="utf-8") as report:
        for line in report:
            print(line, end="")
    return 2 if total["failed"] else 0


def compare_files(args: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from .plans.pipeline import process_path

    settings = load_settings(args.settings)
    spark = local_session("*")
    docs = process_path(spark, args.a, settings).withColumn("doc_id", F.lit(1)).union(process_path(spark, args.b, settings).withColumn("doc_id", F.lit(2)))
    rows = {r["doc_id"]: r for r in docs.select("doc_id", "status", "error", "display_text", "structured_text").collect()}  # two rows
    for row in rows.values():
        if row["status"] != "success":
            print(row["error"])
            return 2
    if args.mode == "diff":
        found = compare.diff_pair(rows[1]["display_text"], rows[2]["display_text"])
        print(f"相似度：{found['similarity_pct']}（+{found['added']} / -{found['removed']}）")
        print("\n".join(found["diff_lines"][:200]))
        return 0
    texts = spark.createDataFrame([(k, r["structured_text"]) for k, r in rows.items()], "doc_id int, text string")
    pairs = spark.createDataFrame([(1, 1, 2)], "pair_id int, a int, b int")
    row = compare.semantic_similarity(texts, pairs, settings["compare"]["semantic_model_dir"]).first()
    print(f"語意相似度：{row['score']}（{row['method']}）")
    return 0


def verify(args: argparse.Namespace) -> int:
    path = args.log or str(Path(load_settings(args.settings)["paths"]["logs"]) / "audit.jsonl")
    ok, message = audit.verify_file(local_session("*"), path) if Path(path).exists() else (True, audit.NO_LOG)
    print(("✅ " if ok else "❌ ") + message)
    return 0 if ok else 1


REQUIRED = ("pyspark", "pyarrow", "pandas", "numpy")
OPTIONAL = {"fitz": "PDF", "PIL": "影像", "paddleocr": "OCR", "markitdown": "Office", "docx": "Word", "openpyxl": "Excel", "pptx": "PPT", "extract_msg": "Outlook", "sentence_transformers": "語意比對", "yaml": "設定檔"}


def doctor(args: argparse.Namespace) -> int:
    """Exit code 1 if anything required is missing."""
    missing = [name for name in REQUIRED if importlib.util.find_spec(name) is None]
    for name in REQUIRED:
        print(f"{'❌' if name in missing else '✅'} {name}")
    for name, what in OPTIONAL.items():
        print(f"{'✅' if importlib.util.find_spec(name) else '⚪'} {name}（{what}）")
    return 1 if missing else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliospark")
    parser.add_argument("--settings", default=None)
    verbs = parser.add_subparsers(dest="verb", required=True)
    p = verbs.add_parser("process")
    p.add_argument("path")
    p.add_argument("--no-mask", action="store_true")
    p.add_argument("--out", default="output")
    p.set_defaults(run=process)
    p = verbs.add_parser("compare")
    p.add_argument("a")
    p.add_argument("b")
    p.add_argument("--mode", choices=("diff", "semantic"), default="diff")
    p.set_defaults(run=compare_files)
    p = verbs.add_parser("verify-audit")
    p.add_argument("log", nargs="?")
    p.set_defaults(run=verify)
    verbs.add_parser("doctor").set_defaults(run=doctor)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())

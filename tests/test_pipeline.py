"""Files to results, end to end, plus streams, settings and the command line."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from foliospark import cli
from foliospark.config import DEFAULTS, load_settings, merge
from foliospark.operators import audit, batch
from foliospark.plans.pipeline import RESULT, process_path
from foliospark.sources.manifest import manifest
from foliospark.sources.sinks import markdown_name, write_markdown
from foliospark.streaming import pipeline as streams


def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.txt").write_text("聯絡手機 0912-000-111", encoding="utf-8")
    (tmp_path / "_hidden.md").write_text("隱藏", encoding="utf-8")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "broken.docx").write_bytes(b"PK\x03\x04...")
    (tmp_path / "skip.exe").write_bytes(b"MZ")
    (tmp_path / "sub" / "b.TXT").write_text("第二份", encoding="utf-8")
    return tmp_path


def test_process_folder(spark, tmp_path):
    rows = {r["file_name"]: r for r in process_path(spark, folder(tmp_path)).collect()}
    assert set(rows) == {"b.txt", "_hidden.md", "empty.txt", "broken.docx", "b.TXT"}
    good = rows["b.txt"]
    assert tuple(good.asDict()) == RESULT and good["doc_type"] == "text" and good["display_text"] == "聯絡手機 《手機號碼》" and good["structured_text"].endswith("111")
    assert (rows["empty.txt"]["status"], rows["empty.txt"]["error"]) == ("failed", "檔案是空的（0 KB）。")
    assert rows["broken.docx"]["error"] == "檔案已損壞或無法開啟。" and rows["broken.docx"]["pii_report"] is None
    unmasked = process_path(spark, tmp_path / "b.txt", mask=False).first()
    assert unmasked["display_text"].endswith("111") and "《手機號碼》" in unmasked["pii_report"]["masked_text"]


def test_size_limit_and_sinks(spark, tmp_path):
    folder(tmp_path)
    limited = process_path(spark, tmp_path, merge(DEFAULTS, {"limits": {"max_file_size_mb": 0.00001}}))
    assert "檔案過大" in limited.filter("file_name = 'b.txt'").first()["error"]
    results = process_path(spark, tmp_path).cache()
    assert write_markdown(results, tmp_path / "out", tmp_path) == 3
    written = {str(p.relative_to(tmp_path / "out")): p.read_text(encoding="utf-8") for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert written == {"b.txt.md": "聯絡手機 《手機號碼》", "_hidden.md.md": "隱藏", "sub/b.TXT.md": "第二份"}
    assert batch.summary(results).first()["failed"] == 2


def test_outputs_of_equal_stems_keep_apart(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "a").mkdir(parents=True)
    for name in ("z.txt", "z.md", "z.csv", "a/z.txt"):
        (source / name).write_text(name, encoding="utf-8")
    assert write_markdown(process_path(spark, source), out, source) == 4
    assert {str(p.relative_to(out)): p.read_text() for p in out.rglob("*.md")} == {f"{n}.md": n for n in ("z.txt", "z.md", "z.csv", "a/z.txt")}
    assert markdown_name("s3://bucket/x/a.txt") == "bucket/x/a.txt.md" and markdown_name("/in/../x.txt", "/other") == "in/x.txt.md"


def test_listing(spark, tmp_path):
    folder(tmp_path)
    (tmp_path / "sub" / "deep").mkdir()
    (tmp_path / "sub" / "deep" / "x.csv").write_text("1", encoding="utf-8")
    for path in (tmp_path, f"file://{tmp_path}", f"file:{tmp_path}"):
        rows = manifest(spark, path).orderBy("ord").collect()
        files = [r["file"] for r in rows]
        assert files == sorted(files, key=lambda f: f.split("/")) and len(files) == 6 and not any("skip" in f for f in files)
        assert {r["file_name"]: r["length"] for r in rows}["empty.txt"] == 0
    assert [r["file_name"] for r in manifest(spark, tmp_path / "skip.exe").collect()] == ["skip.exe"]
    assert manifest(spark, tmp_path / "nothing").collect() == []
    rows = {r["file_name"]: r for r in process_path(spark, f"file://{tmp_path}").collect()}
    assert rows["empty.txt"]["error"] == "檔案是空的（0 KB）。" and rows["x.csv"]["status"] == "success"


def test_rules_of_the_settings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("健保卡 123456789012；工號 K-77；信箱 a at b", encoding="utf-8")
    rules = tmp_path / "rules.yaml"
    rules.write_text("pii_rules:\n  - {name: BADGE, label: 工號, regex: 'K-\\d+'}\n  - {name: EMAIL, label: 信箱, regex: '\\w+ at \\w+'}\n", encoding="utf-8")
    shown = lambda path: process_path(spark, tmp_path / "in", merge(DEFAULTS, {"paths": {"pii_rules": path}})).first()["display_text"]
    assert shown("shipped") == "健保卡 《健保卡號》；工號 K-77；信箱 a at b"
    assert shown(str(rules)) == "健保卡 123456789012；工號 《工號》；信箱 《信箱》"
    assert shown(None) == shown(str(tmp_path / "none")) == "健保卡 123456789012；工號 K-77；信箱 a at b"


def test_audit_of_a_run(spark, tmp_path):
    folder(tmp_path)
    log = tmp_path / "logs" / "audit.jsonl"
    process_path(spark, tmp_path / "sub", audit_log=log)
    process_path(spark, tmp_path / "b.txt", audit_log=log, mask=False)
    events = [json.loads(line) for line in log.read_text(encoding="utf-8").splitlines()]
    assert [(e["event"], e["file"]) for e in events] == [("pii_scan", "b.TXT"), ("process", "b.TXT"), ("pii_scan", "b.txt"), ("process", "b.txt")]
    assert [e["masked"] for e in events if e["event"] == "process"] == [True, False] and audit.verify_file(spark, log) == (True, audit.INTACT)


def test_settings(tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("limits: {max_retries: 7}\nextra: 1\n", encoding="utf-8")
    loaded = load_settings(path)
    assert loaded["limits"]["max_retries"] == 7 and loaded["limits"]["max_pdf_pages"] == 1000 and loaded["extra"] == 1
    for bad in ("- a list", "a: [", ""):
        path.write_text(bad, encoding="utf-8")
        assert load_settings(path) == DEFAULTS
    assert load_settings(tmp_path / "none") == DEFAULTS and load_settings() == DEFAULTS


def test_streams(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("寄 x@y.tw", encoding="utf-8")
    streams.run_files(spark, str(source), str(out), str(tmp_path / "c")).awaitTermination()
    (source / "b.txt").write_text("無", encoding="utf-8")
    streams.run_files(spark, str(source), str(out), str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r["display_text"] for r in rows) == ["寄 《電子郵件》", "無"] and len({r["batch_id"] for r in rows}) == 2


def test_windowed_stream(spark, tmp_path):
    at = datetime(2024, 1, 1, 10, 30)
    rows = [(1, at, "success", 1.0), (1, at, "success", 1.0), (2, at, "failed", 3.0), (3, at.replace(hour=12), "success", 2.0)]
    spark.createDataFrame(rows, "id int, processed_at timestamp, status string, duration_sec double").coalesce(1).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema("id int, processed_at timestamp, status string, duration_sec double").parquet(str(tmp_path / "r"))
    # each key once, then counted by window
    kept = streams.deduplicated(stream, "id", "processed_at", "1 day")
    plan = kept.groupBy(F.window("processed_at", "1 hour"), "status").agg(F.count("*").alias("n"))
    query = plan.writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    batchwise = {(r["window_start"].hour, r["status"]): r["results"] for r in streams.status_windows(spark.createDataFrame(rows, "id int, processed_at timestamp, status string, duration_sec double")).collect()}
    assert batchwise == {(10, "success"): 2, (10, "failed"): 1, (12, "success"): 1}
    masked = streams.protected_stream(spark.readStream.text(str(tmp_path)).withColumnRenamed("value", "text"))
    assert masked.isStreaming and "pii_report" in masked.columns


def test_command_line(capsys, tmp_path):
    assert cli.main(["doctor"]) == 0 and "pyspark" in capsys.readouterr().out
    assert cli.main(["verify-audit", str(tmp_path / "none.jsonl")]) == 0
    broken = tmp_path / "log.jsonl"
    broken.write_text("{}\n", encoding="utf-8")
    assert cli.main(["verify-audit", str(broken)]) == 1
    assert cli.main(["process", str(tmp_path / "nothing")]) == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("手機 0912-345-678", encoding="utf-8")
    (tmp_path / "in" / "bad.docx").write_bytes(b"PK\x03\x04..")
    settings = tmp_path / "s.yaml"
    settings.write_text(f"paths: {{logs: {tmp_path}/logs}}\n", encoding="utf-8")
    assert cli.main(["--settings", str(settings), "process", str(tmp_path / "in"), "--out", str(tmp_path / "out")]) == 2
    shown = capsys.readouterr().out
    assert "- 總計：2 份" in shown and "| a.txt | ✅ 成功 |" in shown and (tmp_path / "out" / "report.md").read_text(encoding="utf-8") in shown
    assert (tmp_path / "out" / "a.txt.md").read_text(encoding="utf-8") == "手機 《手機號碼》"
    assert cli.main(["--settings", str(settings), "verify-audit"]) == 0
    assert cli.main(["compare", str(tmp_path / "in" / "a.txt"), str(tmp_path / "in" / "a.txt")]) == 0 and "100.0%" in capsys.readouterr().out

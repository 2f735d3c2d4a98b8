"""Routing, structure, comparison, batches, audit."""

import difflib
import importlib.machinery
import io
import json
import math
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.errors import MESSAGES
from foliospark.operators import audit, batch, compare, images, routing, structure
from foliospark.sources import extract as ex


def zipped(*names):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name in names:
            z.writestr(name, "<w>正文</w>")
    return raw.getvalue()


CASES = [
    (b"\x89PNG\r\n\x1a\nrest", "x.pdf", "image"), (b"\xff\xd8\xff\xe0", "y.docx", "image"), (b"RIFF....WEBP", "w", "image"), (b"RIFF....AVI \x00", "w", "unknown"), (b"GIF89a", "g", "image"),
    (zipped("word/document.xml"), "z.bin", "word"), (zipped("xl/a.xml"), "z", "excel"), (zipped("ppt/a.xml"), "z", "ppt"), (zipped("other/a"), "z", "unknown"), (zipped("xl/a", "word/a"), "z", "word"),
    (b"PK\x03\x04 broken", "b.docx", "corrupted"), (bytes.fromhex(routing.OLE) + b"..", "m.MSG", "email"), (bytes.fromhex(routing.OLE), "d.doc", "legacy_office"),
    (b"junk%PDF-1.7", "p", "pdf_digital"), (b"From: a\nTo: b\nDate: c\n\nhi", "e.txt", "email"), (b"From: a\nhello", "e.txt", "text"), ("繁體中文內容".encode("big5"), "b.txt", "text"),
    ("字".encode() * 800, "long.txt", "text"), (b"a\x00b", "n.bin", "unknown"), (b"", "e", "empty"), (b"BM text", "t.txt", "image"), (b"\xff\xfe\xfd", "q", "unknown"),
]


def test_detect_type(spark):
    df = spark.createDataFrame([(i, bytearray(c), n) for i, (c, n, _) in enumerate(CASES)], "i int, content binary, file string")
    rows = {r["i"]: r["t"] for r in df.select("i", routing.detect_type(F.col("content"), F.col("file")).alias("t")).collect()}
    assert [rows[i] for i in range(len(CASES))] == [expected for *_, expected in CASES]
    cut = df.filter(F.col("i") == 17).select(routing.detect_type(F.col("content"), F.col("file"), strict=True).alias("t")).first()["t"]
    assert cut == "unknown"  # a header cut inside a character, read strictly


def test_size_error(spark):
    df = spark.createDataFrame([(0,), (10,), (3 * 1024 * 1024,)], "n bigint")
    codes = [r["e"] and r["e"]["code"] for r in df.select(routing.size_error(F.col("n"), 2).alias("e")).collect()]
    assert codes == ["empty", None, "too_large"]


def test_classify_pdf(spark):
    long, short = "字" * 60, "短"
    cases = [([long] * 8 + [short] * 2, "pdf_digital"), ([short] * 10, "pdf_scanned"), ([long] * 5 + [short] * 5, "pdf_mixed"), ([long] * 30 + [short] * 99, "pdf_digital"), ([], "corrupted"), ([None], "pdf_scanned")]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p array<string>")
    rows = {r["i"]: r["k"] for r in df.select("i", routing.classify_pdf(F.col("p")).alias("k")).collect()}
    assert [rows[i] for i in range(len(cases))] == [k for _, k in cases]


def test_structure(spark):
    raws = [
        (0, ("text", " 總計１２ \n", None)),
        (1, ("pdf", None, [(1, "甲", [[["a", "b"], ["1", "2"]], []], None), (2, "", None, True)])),
        (2, ("pdf", None, [(1, " 只有一頁 ", [], False)])),
        (3, ("pdf", "ignored", [])),
        (4, ("text", None, None)),
    ]
    df = spark.createDataFrame(raws, f"i int, raw {structure.RAW}")
    rows = {r["i"]: r["t"] for r in df.select("i", structure.structure(F.col("raw")).alias("t")).collect()}
    assert rows[0] == "總計12"
    assert rows[1] == "## 第 1 頁\n\n甲\n\n### 表格 1\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n\n## 第 2 頁"
    assert (rows[2], rows[3], rows[4]) == ("只有一頁", "", "")


def cosine(a, b, n=2):
    left, right = (Counter(s[i : i + n] for i in range(len(s) - n + 1)) for s in ("".join(x.split()) for x in (a or "", b or "")))
    norm = math.sqrt(sum(v * v for v in left.values())) * math.sqrt(sum(v * v for v in right.values()))
    return round(sum(v * right[g] for g, v in left.items()) / norm, 4) if norm else 0.0


def test_ngram_similarity_both_ways(spark):
    texts = ["天氣真好 我們出門", "天氣真好，我們出門去", "完全無關的另一句話", "", None, "一", "aa aa aa", "aaab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pairs = [(i, i // 8, i % 8) for i in range(64)] + [(64, 0, 99)]
    expected = {k: cosine(texts[a], texts[b]) if b < 8 else 0.0 for k, a, b in pairs}
    for fn in (compare.ngram_similarity, compare.ngram_similarity_by_gram):
        found = {r["pair_id"]: r["score"] for r in fn(docs, spark.createDataFrame(pairs, "pair_id int, a int, b int")).collect()}
        assert found == pytest.approx(expected, abs=1e-4)


def test_semantic_similarity(spark):
    docs = spark.createDataFrame([(1, "甲" * 900), (2, "乙"), (3, "")], "doc_id int, text string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, 1, 3)], "pair_id int, a int, b int")
    plain = compare.semantic_similarity(docs, pairs).collect()
    assert {r["method"] for r in plain} == {compare.METHOD_NGRAM}
    rows = {r["pair_id"]: r for r in compare.semantic_similarity(docs, pairs, embed=lambda c: [[float("甲" in s), float("乙" in s)] for s in c]).collect()}
    assert [rows[i]["score"] for i in (1, 2, 3)] == [0.0, 1.0, 0.0] and rows[1]["method"] == compare.METHOD_MODEL


def test_diff(spark):
    a, b = "一\n二\n三\n", "一\n貳\n三\n四"
    df = spark.createDataFrame([(a, b), (a, a), (None, a)], "a string, b string")
    changed, same, missing = [r["d"] for r in df.select(compare.diff_text(F.col("a"), F.col("b")).alias("d")).collect()]
    assert (changed["added"], changed["removed"]) == (2, 1)
    assert changed["similarity_ratio"] == round(difflib.SequenceMatcher(None, a, b).ratio(), 4)
    assert (same["similarity_ratio"], same["similarity_pct"], same["diff_lines"]) == (1.0, "100.0%", [])
    assert missing["similarity_ratio"] is None


def test_field_compare(spark):
    a = {"品名": " 茶葉", "價": "NT$ 1,200 元", "址": "臺南市東區長榮路"}
    b = {"品名": "茶葉 ", "價": "1200.0", "址": "台南市東區長榮路"}
    df = spark.createDataFrame([(1, a, b)], "k int, a map<string,string>, b map<string,string>")
    fields = {"品名": {"type": "exact"}, "價": {"type": "numeric"}, "址": {"type": "fuzzy", "threshold": 0.8}, "缺": {"type": "fuzzy"}, "缺數": {"type": "numeric"}, "缺文": {}}
    compared = compare.field_compare(df, "a", "b", fields)
    rows = {r["field"]: (r["match"], r["score"]) for r in compared.collect()}
    assert rows == {"品名": (True, 1.0), "價": (True, 1.0), "址": (True, 0.875), "缺": (True, 1.0), "缺數": (False, 0.0), "缺文": (True, 1.0)}
    share = compare.match_share(compared, "k").first()
    assert (share["match_n"], share["total"]) == (5, 6)


def results(spark, rows):
    schema = "ord bigint, file string, file_name string, status string, duration_sec double, doc_type string, structured_text string, error string, error_detail string, retries int, pages int, pii_report struct<pii_count:int,pii_types:array<string>>"
    return spark.createDataFrame(rows, schema)


ROWS = [
    (1, "/in/乙.txt", "乙.txt", "failed", 0.5, None, None, "壞檔", "x" * 3000, 1, 1, None),
    (0, "/in/甲.txt", "甲.txt", "success", 1.0, "text", "內容", "", "", 0, 1, (2, ["EMAIL"])),
    (2, "/in/丙.txt", "丙.txt", "skipped", 0.0, None, None, "記憶體", "", 0, 1, None),
]


def test_batch_reports(spark):
    df = results(spark, ROWS)
    assert batch.summary(df).first().asDict() == {"total": 3, "success": 1, "failed": 1, "skipped": 1, "avg_sec": 0.5}
    text = lambda d: "\n".join(r["line"] for r in batch.report_lines(d).orderBy("section", "ord", "part").collect())
    report = text(df)
    assert report.index("甲.txt") < report.index("乙.txt") < report.index("丙.txt")
    assert "（33.3%）" in report and "x" * 2000 in report and "x" * 2001 not in report
    empty = results(spark, [])
    assert batch.summary(empty).first()["avg_sec"] == 0.0 and text(empty) == batch.EMPTY_REPORT
    assert batch.report_table(df).columns == list(batch.SHEET_COLUMNS)


def fold(lines):
    """Plain verification: number and kind of the first fault."""
    prev = audit.GENESIS
    for n, line in enumerate(lines, 1):
        if not line.strip():
            continue
        try:
            entry = json.loads(line)
        except ValueError:
            return n, "json"
        claimed, stated = entry.pop("entry_hash", None), entry.pop("prev_hash", None)
        if stated != prev:
            return n, "link"
        if audit.entry_hash(prev, entry) != claimed:
            return n, "hash"
        prev = claimed
    return None, None


def test_audit(spark, tmp_path):
    log = audit.AuditLog(tmp_path / "a" / "log.jsonl")
    for i in range(6):
        log.write("事件", n=i, text="字\x1f", items=["甲"])
    again = audit.AuditLog(log.path)
    again.write("續", n=7)
    lines = log.path.read_text(encoding="utf-8").splitlines()
    variants = {
        "intact": lines, "tampered": [lines[0].replace('"n": 0', '"n": 9'), *lines[1:]], "deleted": lines[:2] + lines[3:], "tail": lines[:-2], "broken": [*lines[:3], "{", *lines[3:]],
        "blank": ["", *lines[:2], "  ", *lines[2:]], "first_gone": lines[1:],
    }
    df = spark.createDataFrame([(name, i, s) for name, rows in variants.items() for i, s in enumerate(rows, 1)], "log_name string, line_no bigint, raw string")
    found = {r["log_name"]: (r["fault_line"], r["fault"]) for r in audit.verify_chains(df).collect()}
    assert found == {name: fold(rows) for name, rows in variants.items()}
    verify = lambda path, anchor=None: audit.verify_file(spark, path, anchor)
    assert verify(log.path) == (True, audit.INTACT) and verify(log.path, "else")[0] is False and verify(log.path, again.last)[0]
    assert verify(tmp_path / "none") == (True, audit.NO_LOG)
    for name, rows in variants.items():
        path = tmp_path / f"{name}.jsonl"
        path.write_text("\n".join(rows), encoding="utf-8")
        ok, message = verify(path)
        line, kind = fold(rows)
        assert ok == (line is None) and (ok or f"第 {line} 行" in message)
        made = spark.createDataFrame([(kind, line)], "k string, n bigint").select(audit.verdict(F.col("k"), F.col("n")).alias("v")).first()["v"]
        assert made == message


def test_line_separators_inside_a_line_break_no_chain(spark, tmp_path):
    odd = "a\u2028b\u2029c\x85d\x0ce\rf.txt"
    log = audit.AuditLog(tmp_path / "l.jsonl")
    log.write("process", file=odd)
    audit.AuditLog(log.path).write("process", file="second" * 40_000)
    audit.AuditLog(log.path).write("process", file="third")
    assert audit.verify_file(spark, log.path) == (True, audit.INTACT)
    lines = audit.read_log(spark, str(log.path)).orderBy("line_no").collect()
    assert [r["line_no"] for r in lines] == [1, 2, 3] and json.loads(lines[0]["raw"])["file"] == odd
    with log.path.open("a", encoding="utf-8") as out:
        out.write("{broken\n")
    with pytest.raises(ValueError, match="last line"):
        audit.AuditLog(log.path)


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(20_000)), encoding="utf-8")
    (tmp_path / "logs").mkdir()
    path.rename(tmp_path / "logs" / "long.jsonl")
    (tmp_path / "logs" / "other.jsonl").write_text("line 0 \n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = audit.read_log(spark, str(tmp_path / "logs"))
        assert lines.rdd.getNumPartitions() > 1 or lines.count() == 20_001
        wrong = lines.filter("CAST(split(raw, ' ')[1] AS BIGINT) <> line_no - 1")
        assert wrong.count() == 0 and lines.count() == 20_001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_audit_across_blocks(spark, tmp_path):
    log = audit.AuditLog(tmp_path / "l.jsonl")
    entries = log.write_all({"event": "e", "n": i} for i in range(12))
    lines = [json.dumps(e, ensure_ascii=False) for e in entries]
    df = spark.createDataFrame([("l", i * 30_000, s) for i, s in enumerate(lines) if i != 7], "log_name string, line_no bigint, raw string")
    assert [(r["line_no"], r["fault"]) for r in audit.chain_faults(df).collect()] == [(240_000, "link")]


def test_audit_events(spark):
    events = [r.asDict() for r in audit.events(results(spark, ROWS), "hash", False).collect()]
    assert [e["event"] for e in events] == ["pii_scan", "process"] and events[0]["pii_count"] == 2 and events[1]["chars"] == 2 and events[1]["masked"] is False


SETTINGS = {"limits": {"max_retries": 2, "retry_backoff_sec": 0.0, "max_pdf_pages": 9}, "ocr": {"engine": "none", "min_text_len_per_page": 50}}


def test_read_one():
    calls = []

    def flaky(raw, path, settings):
        calls.append(path)
        if len(calls) < 2:
            raise RuntimeError("once")
        return {"type": "text", "text": "好"}

    def oom(raw, path, settings):
        raise MemoryError

    def broken(raw, path, settings):
        raise RuntimeError("always")

    assert ex.read_one(b"", "f", "text", SETTINGS, {"text": flaky})["retries"] == 1
    assert ex.read_one(b"", "f", "text", SETTINGS, {"text": oom})["error_code"] == "out_of_memory"
    failed = ex.read_one(b"", "f", "text", SETTINGS, {"text": broken})
    assert (failed["error_code"], failed["retries"], failed["error"]) == ("unexpected", 3, MESSAGES["unexpected"]) and "always" in failed["error_detail"]
    assert ex.read_one(b"", "f", "unknown", SETTINGS)["error_code"] == "unsupported_format"
    assert ex.read_one(b"no pdf", "f.pdf", "pdf_digital", SETTINGS)["error_code"] in ("dependency_missing", "corrupted")
    assert ex.read_one(b"no image", "f.png", "image", SETTINGS)["error_code"] in ("dependency_missing", "corrupted")
    assert ex.read_one(b"", "m.msg", "email", SETTINGS)["error_code"] in ("unsupported_format", "unexpected")


def test_readers():
    assert ex.decode_chain("﻿字".encode()) == "字" and ex.decode_chain("測試".encode("big5")) == "測試" and "�" in ex.decode_chain(b"\xff\xff\xff")
    mail = "From: 甲 <a@b.tw>\nTo: c@d.tw\nSubject: =?utf-8?b?5ris6Kmm?=\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n<p>您<b>好</b></p>\n--B\nContent-Type: text/plain\nContent-Disposition: attachment; filename=\"附.txt\"\n\nx\n--B\nContent-Type: application/pdf\nContent-Disposition: attachment\n\nx\n--B--\n"
    text = ex.read_email(mail.encode(), "m.eml", SETTINGS)["text"]
    assert "主旨：測試" in text and " 您 好" in text and "（未命名）" not in text and "(未命名)" in text
    assert ex.ooxml_parts(zipped("word/document.xml", "xl/sharedStrings.xml", "other.xml")) == ["<w>正文</w>"] * 2 and ex.ooxml_parts(b"no zip") == []
    with pytest.raises(ex.DocumentError):
        ex.read_office(b"no zip", "f.doc", SETTINGS)
    assert ex._ocr_lines([[[None, ("甲", 0.9)], [None, ("乙", 0.8)]], None, {"rec_texts": ["丙"]}]) == "甲\n乙\n丙"


def test_office_text(spark):
    files = [("a.docx", zipped("word/document.xml", "xl/sharedStrings.xml")), ("b.docx", zipped("word/other.xml")), ("c.docx", zipped("word/document.bin"))]
    rows = [(f, f, i, "word", bytearray(c), None, None) for i, (f, c) in enumerate(files)]
    df = spark.createDataFrame(rows, "file string, file_name string, ord bigint, doc_type string, content binary, error_code string, error string")
    found = {r["file"]: r for r in ex.extract(df, SETTINGS).collect()}
    assert found["a.docx"]["raw"]["text"] == "正文\n正文" and found["a.docx"]["raw"]["type"] == "office"
    assert {f: found[f]["error_code"] for f in found} == {"a.docx": None, "b.docx": "corrupted", "c.docx": "corrupted"}


def test_ocr_engine(tmp_path):
    settings = {"ocr": {"engine": "paddle", "lang": "en", "use_gpu": "auto"}, "paths": {"models": str(tmp_path)}}
    (tmp_path / "det").mkdir()
    (tmp_path / "det" / "inference.pdmodel").write_bytes(b"")
    calls = []

    class Engine:
        def __init__(self, **arguments):
            calls.append(arguments)
            if "det_model_dir" in arguments or "show_log" in arguments:
                raise TypeError("unknown argument")

        def ocr(self, image):
            return [[[None, (image, 0.9)]]]

    made = ex.OcrEngine(settings, Engine)
    assert made.read("甲") == "甲" and [sorted(c) for c in calls] == [
        ["det_model_dir", "lang", "show_log", "use_angle_cls", "use_gpu"], ["det_model_dir", "lang", "use_angle_cls"], ["lang", "show_log", "use_angle_cls", "use_gpu"], ["lang", "use_angle_cls"],
    ]
    assert ex.wants_gpu({"ocr": {"use_gpu": True}}) and not ex.wants_gpu(settings)
    with pytest.raises(ex.DocumentError, match="OCR"):
        ex.OcrEngine({"ocr": {"engine": "none"}}).read("甲")


def test_images():
    page = np.full((150, 240), 250, np.uint8)
    page[30:120:15, 20:220] = 10
    page[31:121:15, 20:220] = 10
    tilted = images.rotate(page, 4)
    assert 3 < abs(images.skew_angle(tilted)) < 5 and abs(images.skew_angle(images.deskew(tilted))) < 1
    assert images.skew_angle(np.full((50, 50), 255, np.uint8)) is None and images.deskew(page) is page
    assert set(np.unique(images.prepare(page))) <= {0, 255}
    photo = np.tile(np.arange(64, 192, dtype=np.uint8), (40, 1))
    assert images.maybe_binarize(photo) is photo
    assert min(images.scale_for_ocr(page, 300).shape) == 300 and images.scale_for_ocr(page, 100) is page
    assert images.to_gray(np.dstack([page] * 3)).shape == page.shape and images.median3(page).shape == page.shape
    noisy = np.clip(page + np.random.default_rng(1).normal(0, 5, page.shape), 0, 255).astype(np.uint8)
    assert np.abs(images.denoise(noisy).astype(int) - page).mean() < np.abs(noisy.astype(int) - page).mean()


class Page:
    def __init__(self, text, tables=()):
        self.text, self.tables = text, tables

    def get_text(self):
        return self.text

    def find_tables(self):
        if self.tables is None:
            raise RuntimeError("no tables")
        return [type("T", (), {"extract": lambda self, t=t: t})() for t in self.tables]

    def get_pixmap(self, dpi, colorspace):
        return type("P", (), {"samples": bytes([255] * 400), "height": 20, "width": 20})()


@pytest.fixture
def pdf(monkeypatch):
    """A stand-in for the PDF library: what is 'opened' is a list of pages."""
    import sys
    import types

    held = types.SimpleNamespace(pages=[], opened=0, closed=0, locked=False)

    class Document:
        needs_pass = property(lambda self: held.locked)
        __len__ = lambda self: len(held.pages)
        __getitem__ = lambda self, i: held.pages[i]

        def close(self):
            held.closed += 1

    def open_(stream, filetype):
        if stream == b"broken":
            raise ValueError("no PDF")
        held.opened += 1
        return Document()

    module = types.ModuleType("fitz")
    module.open, module.__spec__ = open_, importlib.machinery.ModuleSpec("fitz", None)
    monkeypatch.setitem(sys.modules, "fitz", module)
    return held


PDF_SETTINGS = {
    "limits": {"max_retries": 0, "retry_backoff_sec": 0.0, "max_pdf_pages": 25, "pdf_chunk_pages": 10},
    "ocr": {"engine": "x", "dpi": 100, "min_text_len_per_page": 5, "digital_coverage": 0.8, "scanned_coverage": 0.1},
}


def test_pdf_kinds_and_pages(pdf, monkeypatch):
    engine = type("E", (), {"read": lambda self, image: "recognised"})()
    monkeypatch.setattr(ex.OcrEngine, "get", classmethod(lambda cls, settings: engine))
    row = {"file": "a.pdf", "file_name": "a.pdf", "ord": 1, "content": b"x", "doc_type": "pdf_digital", "error_code": None, "error": None}
    pdf.pages = [Page(f" page {i} ", None if i == 3 else [[["a", "b"]]]) for i in range(30)]
    read = ex.route_and_read(row, PDF_SETTINGS, None)
    pages = read["raw"]["pages"]
    assert (read["doc_type"], len(pages), pages[0], pages[3]["tables"]) == ("pdf_digital", 25, {"page": 1, "text": "page 0", "tables": [[["a", "b"]]], "ocr": None}, [])
    assert pdf.opened == 1 + 3 and pdf.closed == 2  # once to look, then once for each ten pages
    pdf.pages = [Page("")] * 10
    read = ex.route_and_read(row, PDF_SETTINGS, None)
    assert read["doc_type"] == "pdf_scanned" and {(p["text"], p["ocr"]) for p in read["raw"]["pages"]} == {("recognised", True)}
    pdf.pages = [Page("long enough"), Page("")]
    read = ex.route_and_read(row, PDF_SETTINGS, None)
    assert read["doc_type"] == "pdf_mixed" and [(p["text"], p["ocr"]) for p in read["raw"]["pages"]] == [("long enough", False), ("recognised", True)]
    pdf.pages = []
    assert ex.route_and_read(row, PDF_SETTINGS, None)["error_code"] == "corrupted"
    assert ex.route_and_read(row | {"content": b"broken"}, PDF_SETTINGS, None)["error_code"] == "corrupted"
    pdf.locked = True
    assert ex.route_and_read(row, PDF_SETTINGS, None)["error"] == MESSAGES["password"]

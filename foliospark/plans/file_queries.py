"""Queries of listing, routing, reading, sinks, reports and logs. Files are written from the tables first,
to the shared folder that also holds checkpoints, or made in memory; oracles follow how they were made."""

from __future__ import annotations

import email.message
import io
import json
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, merge
from ..errors import DocumentError
from ..operators import audit, batch, compare, routing, structure
from ..sources import extract as readers
from ..sources import sinks
from ..sources.manifest import manifest, with_content
from ..sources.storage import write_bytes
from ..sources.tables import table, text_rows
from ..session import ensure_checkpoint_dir
from .pipeline import process_path, results_of, route
from .registry import RESULTS, clean_sql, once, query, strip_sql

FILES = "file string, file_name string, ord bigint, length bigint, content binary, error_code string, error string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def made_files(df: DataFrame, make: Callable[[tuple], tuple[str, bytes]]) -> DataFrame:
    """Rows of ``FILES``, a file for each row; the row's first column becomes ``ord``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples(index=False, name=None):
                name, content = make(row)
                out.append((f"/in/{name}", name, row[0], len(content), content, None, None))
            yield pd.DataFrame(out, columns=["file", "file_name", "ord", "length", "content", "error_code", "error"])

    return df.mapInPandas(run, FILES)


# ---- listing and whole runs ------------------------------------------------------------------------

_WHERE = "['a', '_b', '.c', 'd/e', 'd']"
_SUFFIX = "CASE WHEN doc_id % 7 = 0 THEN '.exe' WHEN doc_id % 7 = 1 THEN '.TXT' ELSE '.md' END"
_FOLDER = f"({_WHERE})[CAST(doc_id % 5 AS INTEGER) + 1]"
_FILE = f"{_FOLDER} || '/' || doc_id || {_SUFFIX}"


def _folder_of_documents(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files, in folders of all sorts; a null text has no file, an empty one an empty file."""
    folder = scratch(spark, "in")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = str(TaskContext.get().taskAttemptId())
        for rows in batches:
            for key, text in zip(rows["doc_id"], rows["text"]):
                name = f"{('a', '_b', '.c', 'd/e', 'd')[key % 5]}/{key}{'.exe' if key % 7 == 0 else '.TXT' if key % 7 == 1 else '.md'}"
                write_bytes(f"{folder}/{name}", text.encode("utf-8", "replace"), attempt)
            yield pd.DataFrame({"n": [len(rows)]})

    text_rows(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null").mapInPandas(run, "n bigint").agg(F.sum("n")).collect()
    return folder


@query(f"SELECT {_FOLDER} AS folder, doc_id || {_SUFFIX} AS file_name, CAST(octet_length(encode(text)) AS BIGINT) AS length FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0")
def scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files listed by the executors: hidden names, empty files, known suffixes in any case."""
    folder = _folder_of_documents(spark, sf_dir)
    below = F.regexp_extract("file", r"/in-[0-9a-f]+/(.*)/[^/]*$", 1)
    return manifest(spark, folder).select(below.alias("folder"), "file_name", "length")


_DECODED = clean_sql("ltrim(text, chr(65279))")


@query(f"""SELECT doc_id || {_SUFFIX} AS file_name, CAST(row_number() OVER (ORDER BY string_split({_FILE}, '/')) AS BIGINT) AS place,
        CASE WHEN text = '' THEN 'failed' ELSE 'success' END AS status, CASE WHEN text = '' THEN NULL ELSE md5({_DECODED}) END AS structured
    FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0""")
def process_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over a folder: listed, checked, read, structured and protected, in the order of the paths."""
    from pyspark.sql.window import Window

    rows = process_path(spark, _folder_of_documents(spark, sf_dir))
    place = F.row_number().over(Window.orderBy("ord"))  # one task: only to show the order
    return rows.select("file_name", place.cast("bigint").alias("place"), "status", F.md5("structured_text").alias("structured"))


@query(f"SELECT {_FILE} || '.md' AS name, md5({_DECODED}) AS body FROM documents WHERE text <> '' AND doc_id % 7 <> 0")
def markdown_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's texts written as Markdown files by the executors, and read back."""
    source, out = _folder_of_documents(spark, sf_dir), scratch(spark, "out")
    sinks.write_markdown(process_path(spark, source, mask=False), out, source)
    written = with_content(manifest(spark, out))
    body = F.md5(F.coalesce(F.col("content").cast("string"), F.lit("")))  # an empty file is not read
    return written.select(F.regexp_extract("file", r"/out-[0-9a-f]+/(.*)$", 1).alias("name"), body.alias("body"))


_CUSTOM = r"""pii_rules:
  - {name: BADGE, label: 工號, regex: 'K-\d+', score: 0.9}
  - {name: NHI_CARD, label: 健保卡號, regex: '(?<!\d)\d{12}(?!\d)', score: 0.7, context_words: ["健保"]}
"""


@query("""SELECT c_custkey, '工號 《工號》，健保 《健保卡號》，信箱 《電子郵件》，' || c_name AS shown, CAST(3 AS INTEGER) AS pii_count, 'BADGE,EMAIL,NHI_CARD' AS pii_types FROM customer""")
def process_files_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files processed with the rules of a YAML file that the settings name, beside the built-in ones."""
    customers = text_rows(spark, sf_dir, "customer", "c_custkey", "c_name")
    files = made_files(customers, lambda row: (f"{row[0]}.txt", f"工號 K-{row[0]}，健保 {row[0]:012d}，信箱 c{row[0]}@x.example，{row[1]}".encode()))
    with tempfile.NamedTemporaryFile("w", suffix=".yaml", encoding="utf-8") as rules:  # read by the driver while the plan is made
        rules.write(_CUSTOM)
        rules.flush()
        rows = results_of(files, merge(DEFAULTS, {"paths": {"pii_rules": rules.name}}))
    return rows.select(F.col("ord").alias("c_custkey"), F.col("display_text").alias("shown"), "pii_report.pii_count", F.array_join("pii_report.pii_types", ",").alias("pii_types"))


# ---- routing and reading ---------------------------------------------------------------------------


def zipped(entries: dict[str, str]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as archive:
        for name, body in entries.items():
            archive.writestr(name, body)
    return raw.getvalue()


_OLE = bytes.fromhex(routing.OLE)
#: Name, content and expected type of a file for each remainder of the key.
_ROUTED: list[tuple[str, bytes, str]] = [
    ("a.bin", zipped({"word/document.xml": "<w/>"}), "word"), ("a.docx", zipped({"xl/workbook.xml": "<x/>"}), "excel"), ("a.zip", zipped({"ppt/slides/slide1.xml": "<p/>"}), "ppt"),
    ("a.docx", zipped({"other/a.xml": "<o/>"}), "unknown"), ("b.xlsx", zipped({"xl/a.xml": "<x/>", "word/b.xml": "<w/>"}), "word"), ("b.docx", b"PK\x03\x04 broken", "corrupted"),
    ("m.MSG", _OLE + b"....", "email"), ("m.doc", _OLE + b"....", "legacy_office"), ("m.txt", b"From: a\nTo: b\nSubject: c\n\nbody", "email"), ("n.txt", b"From: a\nTo: b\n\nbody", "text"),
    ("b5.txt", "繁體中文的公文內容".encode("big5"), "text"), ("z.txt", b"text\0with nul", "unknown"), ("long.txt", ("字" * 800).encode(), "text"), ("late.pdf", b"x" * 900 + b"%PDF-1.4", "pdf_digital"),
    ("no.pdf", b"\xff\xfe" * 600 + b"%PDF-1.4", "unknown"), ("w.jpg", b"RIFF\0\0\0\0WEBPVP8 ", "image"), ("cp.txt", "恒裏".encode("cp950"), "text"), ("q.txt", b"\xff\xfe\xfd", "unknown"), ("e.txt", b"", "empty"),
]


@query(f"SELECT o_orderkey, CASE o_orderkey % {len(_ROUTED)} " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (*_, kind) in enumerate(_ROUTED)) + " END AS doc_type FROM orders")
def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, mails, old Office files, Big5, cut and broken headers, routed by content."""
    files = made_files(text_rows(spark, sf_dir, "orders", "o_orderkey"), lambda row: _ROUTED[row[0] % len(_ROUTED)][:2])
    return route(files).select(F.col("ord").alias("o_orderkey"), "doc_type")


_LINE = "|| chr(10) ||"


@query(f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 'failed' ELSE 'success' END AS status,
        CASE c_custkey % 4 WHEN 0 THEN c_name {_LINE} '段落 ' || c_custkey {_LINE} c_mktsegment WHEN 1 THEN c_name {_LINE} 'R&amp;D ' || c_custkey WHEN 2 THEN c_mktsegment {_LINE} c_name END AS text FROM customer""")
def read_ooxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, sheets and slides read as bare XML parts, text nodes taken out natively; a container without any fails."""

    def make(row: tuple) -> tuple[str, bytes]:
        key, name, segment = row
        parts = [
            {"word/document.xml": f"<w:p><w:t> {name} </w:t><w:t>段落 {key}</w:t></w:p><w:p>\n</w:p><w:t>{segment}</w:t>", "word/styles.xml": "<s>no text</s>"},
            {"xl/worksheets/sheet1.xml": f"<c><v>{name}</v></c>", "xl/sharedStrings.xml": f"<si><t>R&amp;D {key}</t></si>"},
            {"ppt/slides/slide2.xml": f"<a:t>{segment}</a:t>", "ppt/slides/slide10.xml": f"<a:t>{name}</a:t>"},
            {"word/media.xml": "<a>not read</a>", "word/document.bin": "<a>nor this</a>"},
        ]
        return f"{key}.docx", zipped(parts[key % 4])

    files = made_files(text_rows(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment"), make)
    rows = results_of(files, rules=(), readers=readers.READERS)
    return rows.select(F.col("ord").alias("c_custkey"), "status", F.col("structured_text").alias("text"))


@query("""SELECT c_custkey, '寄件者：' || c_name || ' <c@x.example>' || chr(10) || '收件者：' || CASE WHEN c_custkey % 2 = 0 THEN 'd@y.example' ELSE '' END || chr(10) || '主旨：訂單 ' || c_custkey || chr(10) || '日期：'
        || chr(10) || chr(10) || CASE c_custkey % 3 WHEN 0 THEN ' 餘額 ' || c_mktsegment || '  ' || chr(10) WHEN 1 THEN 'plain ' || c_mktsegment || chr(10) ELSE '' END
        || CASE c_custkey % 3 WHEN 2 THEN '' ELSE chr(10) END || CASE c_custkey % 3 WHEN 1 THEN chr(10) || '附件：表-' || c_custkey || '.csv、(未命名)' ELSE '' END AS text FROM customer WHERE c_custkey % 3 <> 2""")
def read_email_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails with an HTML body alone, and with a plain and an HTML one and attachments, named and not."""

    def make(row: tuple) -> tuple[str, bytes]:
        key, name, segment = row
        mail = email.message.EmailMessage()
        mail["From"], mail["Subject"], mail["X-Received"] = f"{name} <c@x.example>", f"訂單 {key}", "x"
        if key % 2 == 0:
            mail["To"] = "d@y.example"
        if key % 3 == 0:
            mail.set_content(f"<p>餘額 {segment}<br></p>", subtype="html")
        else:
            mail.set_content(f"plain {segment}")
            mail.add_alternative("<p>html</p>", subtype="html")
            mail.add_attachment("a,b", subtype="csv", filename=f"表-{key}.csv")
            mail.add_attachment(b"x", maintype="application", subtype="pdf")
        return f"{key}.eml", b"MIME-Version: 1.0\n" + mail.as_bytes().replace(b"MIME-Version: 1.0\n", b"", 1)

    customers = text_rows(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").filter("c_custkey % 3 <> 2")
    read = readers.extract(route(made_files(customers, make)), DEFAULTS).filter("raw.type = 'email'")
    text = F.when(F.col("ord") % 3 == 0, F.concat("raw.text", F.lit("\n"))).when(F.endswith("raw.text", F.lit("(未命名)")), F.col("raw.text"))
    return read.select(F.col("ord").alias("c_custkey"), text.alias("text"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '訂單編號' || c_custkey WHEN 1 THEN '恒裏 ' || c_custkey WHEN 2 THEN 'bom ' || c_custkey WHEN 3 THEN '壞' || c_custkey || chr(65533) || chr(65533) ELSE '萬國碼 ' || c_custkey END AS text FROM customer""")
def read_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in Big5, in its extension, with a byte-order mark, broken, and in UTF-8."""

    def make(row: tuple) -> tuple[str, bytes]:
        key = row[0]
        content = [f"訂單編號{key}".encode("big5"), f"恒裏 {key}".encode("cp950"), b"\xef\xbb\xbf" + f"bom {key}".encode(), f"壞{key}".encode() + b"\xff\xff", f"萬國碼 {key}".encode()]
        return f"{key}.txt", content[key % 5]

    files = made_files(text_rows(spark, sf_dir, "customer", "c_custkey"), make).withColumn("doc_type", F.lit("text"))
    return readers.extract(files, DEFAULTS).select(F.col("ord").alias("c_custkey"), F.col("raw.text").alias("text"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' WHEN 4 THEN 'failed' ELSE 'success' END AS status,
        CAST(CASE c_custkey % 6 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 5 THEN 2 ELSE 0 END AS INTEGER) AS retries,
        CASE c_custkey % 6 WHEN 2 THEN '處理時發生未預期錯誤，已記錄技術細節。' WHEN 3 THEN '記憶體不足，此檔案已跳過。請關閉其他程式或分批處理。' WHEN 4 THEN '檔案有密碼保護，請先解除密碼後再上傳。' ELSE '' END AS error,
        c_custkey % 6 = 2 AS detailed FROM customer""")
def process_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readers that work, fail once or twice, always fail, run out of memory, or meet an expected error."""
    seen: dict[str, int] = {}

    def reader(raw: bytes, path: str, settings: dict) -> dict:
        kind = int(raw) % 6
        seen[path] = seen.get(path, 0) + 1
        if kind == 2 or kind == 1 and seen[path] <= 1 or kind == 5 and seen[path] <= 2:
            raise RuntimeError("not yet")
        if kind == 3:
            raise MemoryError
        if kind == 4:
            raise DocumentError("password")
        seen.pop(path)
        return {"type": "text", "text": "ok"}

    files = made_files(text_rows(spark, sf_dir, "customer", "c_custkey"), lambda row: (f"{row[0]}.txt", str(row[0]).encode()))
    settings = merge(DEFAULTS, {"limits": {"retry_backoff_sec": 0.0}})
    rows = results_of(files, settings, readers={"text": reader}, rules=())
    return rows.select(F.col("ord").alias("c_custkey"), "status", "retries", "error", F.contains("error_detail", F.lit("not yet")).alias("detailed"))


@query("SELECT c_custkey, c_name || chr(10) || c_mktsegment AS text FROM customer")
def read_ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines in the result formats of either major version, from an engine that needs a second try to load."""

    class Engine:
        def __init__(self, **arguments):
            if "show_log" in arguments:
                raise TypeError("show_log")

        def ocr(self, image):
            key, name, segment = image
            return [{"rec_texts": [name, segment]}] if key % 2 else [[[None, (name, 0.9)]], None, [[None, (segment, 0.8)]]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = readers.OcrEngine(DEFAULTS, Engine)
        for rows in batches:
            yield pd.DataFrame({"c_custkey": rows["c_custkey"], "text": [engine.read(row) for row in rows.itertuples(index=False, name=None)]})

    return text_rows(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").mapInPandas(run, "c_custkey bigint, text string")


@query("""WITH t AS (SELECT n_regionkey, string_agg('| ' || n_nationkey || ' | ' || replace(n_name, 'A', '\\|') || ' |' || chr(10), '' ORDER BY n_nationkey) AS body FROM nation GROUP BY 1)
    SELECT CAST(n_regionkey AS BIGINT) AS region, '## 第 1 頁' || chr(10) || chr(10) || '地區 ' || n_regionkey || chr(10) || chr(10) || '### 表格 1' || chr(10) || chr(10) || '| key | name |' || chr(10) || '|---|---|' || chr(10) || body
        || chr(10) || chr(10) || '### 表格 3' || chr(10) || chr(10) || '| only |' || chr(10) || '|---|' || chr(10) || chr(10) || chr(10) || '## 第 7 頁' || chr(10) || chr(10) || 'end' AS markdown FROM t""")
def pages_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with tables: numbered, an empty one passed over, bars escaped."""
    row = F.array(F.col("n_nationkey").cast("string"), F.replace(F.col("n_name"), F.lit("A"), F.lit("|")))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("s"))
    main = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("s", lambda s: s["row"]))
    none = F.array().cast("array<array<string>>")
    first = F.struct(F.lit(1).alias("page"), F.concat(F.lit("地區 "), F.col("n_regionkey").cast("string"), F.lit("  \n")).alias("text"), F.array(main, none, F.array(F.array(F.lit("only")))).alias("tables"), F.lit(False).alias("ocr"))
    last = F.struct(F.lit(7).alias("page"), F.lit(" end ").alias("text"), F.array().cast("array<array<array<string>>>").alias("tables"), F.lit(True).alias("ocr"))
    return rows.select(F.col("n_regionkey").cast("bigint").alias("region"), structure.structure_pages(F.array(first, last)).alias("markdown"))


# ---- reports and logs ------------------------------------------------------------------------------

_ICON = "CASE status WHEN 'success' THEN '✅ 成功' WHEN 'failed' THEN '❌ 失敗' WHEN 'skipped' THEN '⏭️ 跳過' ELSE '' END"
_NAME = "regexp_extract(file, '[^/\\\\]*$')"
_FAULTS = f"SELECT * FROM {RESULTS} WHERE status = 'failed' AND coalesce(error_detail, '') <> ''"


@query(f"""WITH s AS (SELECT count(*) AS total, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status = 'failed') AS bad, count(*) FILTER (status = 'skipped') AS over, round(avg(duration_sec), 1) AS sec FROM {RESULTS}),
    head AS (SELECT ['# 批量處理報告', '', '## 摘要', '- 總計：' || total || ' 份', '- 成功：' || ok || ' 份（' || printf('%.1f', 100.0 * ok / total) || '%）', '- 失敗：' || bad || ' 份', '- 跳過：' || over || ' 份',
        '- 平均耗時：' || sec || ' 秒/份', '', '## 明細', '| 檔案 | 狀態 | 耗時(秒) | 個資數 | 說明 |', '|---|---|---|---|---|'] AS l FROM s)
    SELECT 0 AS section, CAST(0 AS BIGINT) AS ord, CAST(i AS INTEGER) AS part, l[i + 1] AS line FROM (SELECT l, unnest(range(0, 12)) AS i FROM head)
    UNION ALL SELECT 1, result_id, 0, '| ' || {_NAME} || ' | ' || {_ICON} || ' | ' || coalesce(CAST(duration_sec AS VARCHAR), '0.0') || ' | ' || coalesce(CAST(pii_report.pii_count AS VARCHAR), '') || ' | ' || coalesce(error, '') || ' |' FROM {RESULTS}
    UNION ALL SELECT 2, 0, CAST(i AS INTEGER), ['', '## 失敗技術細節（給資訊人員）', ''][i + 1] FROM (SELECT unnest(range(0, 3)) AS i) WHERE EXISTS ({_FAULTS})
    UNION ALL SELECT 3, result_id, 0, '### ' || {_NAME} || chr(10) || '```' || chr(10) || substr(error_detail, 1, 2000) || chr(10) || '```' || chr(10) FROM ({_FAULTS})""")
def batch_report_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of all results: summary, details and the appendix of failures, line by line."""
    rows = once(spark, sf_dir, "file", "status", "duration_sec", "pii_report", "error", "error_detail").withColumn("ord", F.col("result_id"))
    return batch.report_lines(rows)


@query(f"""SELECT result_id, file_name, status, doc_type, coalesce(pages, -1) AS pages, coalesce(pii_report.pii_count, -1) AS pii_count, duration_sec, retries, error FROM {RESULTS}""")
def report_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's sheet, written as CSV and read back."""
    columns = ("file_name", "status", "doc_type", "pages", "pii_report", "duration_sec", "retries", "error")
    rows = once(spark, sf_dir, *columns).withColumn("ord", F.col("result_id"))
    sheet = batch.report_table(rows, "result_id")
    path = scratch(spark, "sheet")
    sinks.write_csv(sheet, path)
    schema = ", ".join(f"`{c}` {t}" for c, t in sheet.dtypes)
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").schema(schema).csv(path)
    names = ("file_name", "status", "doc_type", "pages", "pii_count", "duration_sec", "retries", "error")
    return read.withColumnsRenamed(dict(zip(batch.SHEET_COLUMNS, names))).na.fill(-1, ["pages", "pii_count"])


_EVENT = """'{"event": "order", "file": "' || c_name || '.txt", "n": ' || c_custkey || ', "timestamp": "2024-01-01T00:00:00+08:00"}'"""


@query(f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
    chain AS (SELECT c_nationkey, k, repeat('0', 64) AS prev, sha256(repeat('0', 64) || {_EVENT}) AS hash, c_name, c_custkey FROM c WHERE k = 1
        UNION ALL SELECT c.c_nationkey, c.k, chain.hash, sha256(chain.hash || {_EVENT.replace("c_name", "c.c_name").replace("c_custkey", "c.c_custkey")}), c.c_name, c.c_custkey FROM chain JOIN c ON c.c_nationkey = chain.c_nationkey AND c.k = chain.k + 1)
    SELECT CAST(c_nationkey AS BIGINT) AS log, CAST(k AS BIGINT) AS line_no,
        '{{"timestamp": "2024-01-01T00:00:00+08:00", "event": "order", "n": ' || c_custkey || ', "file": "' || c_name || '.txt", "prev_hash": "' || prev || '", "entry_hash": "' || hash || '"}}' AS raw FROM chain""")
def audit_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each nation, written in two goes: the second goes on from the last line's claim."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c_custkey")
        payloads = [{"timestamp": "2024-01-01T00:00:00+08:00", "event": "order", "n": int(k), "file": f"{name}.txt"} for k, name in zip(rows["c_custkey"], rows["c_name"])]
        half = len(payloads) // 2
        lines = [line for line, _ in audit.chained(payloads[:half])]
        last = audit.last_claim("".join(f"{line}\n" for line in lines).encode() + b"\n")
        lines += [line for line, _ in audit.chained(payloads[half:], last)]
        return pd.DataFrame({"log": int(rows["c_nationkey"].iloc[0]), "line_no": range(1, len(lines) + 1), "raw": lines})

    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name").groupBy("c_nationkey").applyInPandas(write, "log bigint, line_no bigint, raw string")


@query("""WITH l AS (SELECT log_name, line_no, any_value(raw) AS raw FROM audit_lines GROUP BY 1, 2)
    SELECT log_name, CAST(row_number() OVER (PARTITION BY log_name ORDER BY line_no) AS BIGINT) AS line_no, md5(raw) AS raw FROM l""")
def audit_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs written as files and read again, split into blocks, with their line numbers."""
    lines = table(spark, sf_dir, "audit_lines").select("log_name", "line_no", "raw").dropDuplicates(["log_name", "line_no"])
    path = scratch(spark, "logs")
    lines.repartition("log_name").sortWithinPartitions("log_name", "line_no").select("raw", "log_name").write.partitionBy("log_name").option("lineSep", "\n").text(path)
    read = audit.read_log(spark, path)
    return read.select(F.regexp_extract("log_name", "log_name=([^/]*)/", 1).alias("log_name"), "line_no", F.md5("raw").alias("raw"))


# ---- comparison ------------------------------------------------------------------------------------


@query("""SELECT n_nationkey, CAST(n_nationkey * 10 AS INTEGER) AS added, CAST(n_nationkey * 10 AS INTEGER) AS removed, CAST(CASE WHEN n_nationkey = 0 THEN 0 ELSE least(200, 4 + 20 * n_nationkey) END AS INTEGER) AS shown FROM nation""")
def diff_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that differ in more and more lines, and how much of the diff is shown."""
    k = F.col("n_nationkey")
    lines = lambda word: F.array_join(F.transform(F.sequence(F.lit(0), k * 10), lambda i: F.when(i == 0, F.lit("same")).otherwise(F.concat(F.lit(word), i.cast("string")))), "\n")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", lines("old").alias("a"), lines("new").alias("b"))
    rows = rows.withColumns({"a": F.when(k == 0, F.lit("same")).otherwise(F.col("a")), "b": F.when(k == 0, F.lit("same")).otherwise(F.col("b"))})
    diff = rows.select("n_nationkey", compare.diff_text(F.col("a"), F.col("b")).alias("d"))
    return diff.select("n_nationkey", "d.added", "d.removed", F.size(compare.shown_lines(F.col("d"))).alias("shown"))


_MODE = "CASE WHEN label = '姓名' AND c_custkey % 2 = 1 THEN 2.0 * length(c_name) / (2 * length(c_name) + 1) WHEN label = '日期' AND c_custkey % 3 = 0 THEN 0.0 ELSE 1.0 END"


@query(f"""SELECT c_custkey AS pair_id, label AS field, {_MODE} >= 0.85 AS match, round({_MODE}, 3)::DOUBLE AS score
    FROM customer, (SELECT unnest(['姓名', '日期', '沒有']) AS label)""")
def field_mode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field mode on pairs of documents whose labelled fields differ by one character, are missing, or are equal."""
    name, k = F.col("c_name"), F.col("c_custkey")
    a = F.concat(F.lit("文件\n姓名："), name, F.lit("\n日期: 2024-01-02 |x"))
    b = F.concat(F.lit("姓名 = "), F.when(k % 2 == 1, F.concat(name, F.lit("x"))).otherwise(name), F.when(k % 3 == 0, F.lit("\n")).otherwise(F.lit("\n日期：2024-01-02\n")))
    pairs = table(spark, sf_dir, "customer").select(k.alias("pair_id"), a.alias("a"), b.alias("b"))
    return compare.field_mode(pairs, "a", "b", ["姓名", "日期", "沒有"]).select("pair_id", "field", "match", "score")


def _letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: how often some letters occur in a text."""
    return [[float(text.count(letter)) for letter in "etaoin的一是不"] for text in texts]


_VECTOR = "[" + ", ".join(f"CAST(length(c) - length(replace(c, '{letter}', '')) AS DOUBLE)" for letter in "etaoin的一是不") + "]"
_EMBEDDED = f"""b AS (SELECT doc_id, {strip_sql("text")} AS t FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, substr(t, CAST(s AS INTEGER) + 1, 400) AS c FROM (SELECT doc_id, t, unnest(range(0, greatest(length(t), 1), 400)) AS s FROM b)),
    v AS (SELECT doc_id, unnest(range(1, 11)) AS i, unnest({_VECTOR}) AS x FROM c), m AS (SELECT doc_id, i, avg(x) AS x FROM v GROUP BY 1, 2),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM b a JOIN b ON b.doc_id = a.doc_id + 1),
    s AS (SELECT p.a, p.b, sum(x.x * y.x) AS dot, sqrt(sum(x.x * x.x)) * sqrt(sum(y.x * y.x)) AS norm FROM p JOIN m x ON x.doc_id = p.a JOIN m y ON y.doc_id = p.b AND y.i = x.i GROUP BY 1, 2)"""


def _neighbours(docs: DataFrame) -> DataFrame:
    following = docs.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"))
    return docs.select("doc_id").join(following, F.col("doc_id") == F.col("a")).select(F.col("a").alias("pair_id"), "a", "b")


@query(f"WITH {_EMBEDDED} SELECT a, b, CASE WHEN norm = 0 THEN 0.0 ELSE round(dot / norm, 4) END AS score, '{compare.METHOD_MODEL}' AS method FROM s")
def semantic_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in chunks, each embedded, the means compared; letter counts stand in for a model."""
    docs = text_rows(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    return compare.semantic_similarity(docs, _neighbours(docs), embed=_letters).select("a", "b", "score", "method")


@query(f"SELECT c_custkey - 1 AS a, c_custkey AS b, CASE WHEN c_custkey % 5 IN (0, 1) THEN '{compare.METHOD_NGRAM}' ELSE '{compare.METHOD_MODEL}' END AS method FROM customer WHERE c_custkey > (SELECT min(c_custkey) FROM customer)")
def semantic_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An encoder that fails on some texts at run time: their pairs, and only theirs, are compared by grams."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [None if text.endswith("!") else [1.0, float(len(text))] for text in texts]

    text = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    docs = text_rows(spark, sf_dir, "customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    return compare.semantic_similarity(docs, _neighbours(docs), embed=embed).select("a", "b", "method")


# ---- images ----------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CAST(floor((p_partkey % 256) * 0.114::DOUBLE + (p_size * 5 % 256) * 0.587::DOUBLE + (p_partkey * 7 % 256) * 0.299::DOUBLE + 0.5) AS INTEGER) AS gray FROM part""")
def image_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel of its own colour for each part, made grey."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from ..operators import images

        for rows in batches:
            key = rows["p_partkey"].to_numpy()
            image = np.stack([key % 256, rows["p_size"].to_numpy() * 5 % 256, key * 7 % 256], axis=-1).astype(np.uint8)[None]
            yield pd.DataFrame({"p_partkey": key, "gray": images.to_gray(image)[0].astype("int32")})

    return text_rows(spark, sf_dir, "part", "p_partkey", "p_size").mapInPandas(run, "p_partkey bigint, gray int")


@query("""SELECT c_custkey, CAST(CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE 10 + c_custkey % 90 END AS INTEGER) AS black, CAST(CASE WHEN 20 + c_custkey % 7 >= 24 THEN 20 + c_custkey % 7 ELSE 24 END AS INTEGER) AS height FROM customer""")
def image_black_and_white(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn pages: dark pixels become black ones, photographs stay grey, small pages are enlarged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from ..operators import images

        for rows in batches:
            out = []
            for key in rows["c_custkey"]:
                page = np.full((20 + key % 7, 30), 150 if key % 5 == 0 else 235, np.uint8)
                page.reshape(-1)[: 10 + key % 90] = 25
                made = images.maybe_binarize(page)
                out.append((key, -1 if made is page else int((made == 0).sum()), images.scale_for_ocr(page, 24).shape[0]))
            yield pd.DataFrame(out, columns=["c_custkey", "black", "height"])

    return text_rows(spark, sf_dir, "customer", "c_custkey").mapInPandas(run, "c_custkey bigint, black int, height int")

"""Checks before reading, and the true type of a file from its content."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MESSAGES
from ..functions.udfs import lazy_udf

DOC_TYPES = ("pdf_digital", "pdf_scanned", "pdf_mixed", "word", "excel", "ppt", "image", "email", "text", "legacy_office", "unknown")
# What files begin with.
PDF, ZIP, OLE = "255044462D", "504B0304", "D0CF11E0A1B11AE1"
IMAGES = ("89504E470D0A1A0A", "FFD8FF", "49492A00", "4D4D002A", "424D", "474946383761", "474946383961")
RIFF, WEBP = "52494646", "57454250"
EML_MARKERS = ("Received:", "From:", "To:", "Subject:", "Return-Path:", "MIME-Version:", "Date:")
SUFFIXES = ("pdf", "docx", "xlsx", "xlsm", "pptx", "doc", "xls", "jpg", "jpeg", "png", "tiff", "tif", "bmp", "eml", "msg", "txt", "md", "csv")
HEADER_BYTES = 2048


def _bytes(hexadecimal: str) -> Column:
    return F.unhex(F.lit(hexadecimal))


def suffix(path: Column) -> Column:
    """Lower-case suffix of a path's name without the dot; '' if it has none."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*\.([^./\\]*)$", 1))


def size_error(length: Column, max_mb: float = 200) -> Column:
    """Struct code, message of a file that may not be read, else null. Needs the listing only."""
    mb = length / (1024 * 1024)
    code = F.when(length == 0, F.lit("empty")).when(mb > max_mb, F.lit("too_large"))
    message = F.when(length == 0, F.lit(MESSAGES["empty"])).otherwise(F.format_string(f"檔案過大（%.1f MB，上限 {max_mb} MB）。", mb.cast("double")))
    return F.when(code.isNotNull(), F.struct(code.alias("code"), message.alias("message")))


def image_magic(content: Column) -> Column:
    """Whether the content begins like one of the image formats."""
    found = F.startswith(content, _bytes(RIFF)) & (F.coalesce(F.substring(content, 9, 4), F.lit(b"")) == _bytes(WEBP))
    for magic in IMAGES:
        found = found | F.startswith(content, _bytes(magic))
    return found


@lazy_udf("array<string>")
def zip_names(content: pd.Series) -> pd.Series:
    """Entry names of a ZIP container; null for a broken one."""

    def names(raw: bytes | None) -> list[str] | None:
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                return archive.namelist()
        except Exception:
            return None

    return content.map(names)


def classify_zip(names: Column) -> Column:
    """word, excel, ppt or unknown, by the first of their folders that occurs; corrupted without a listing."""

    def holds(folder: str) -> Column:
        return F.exists(names, lambda n: F.startswith(n, F.lit(folder)))

    kind = F.when(holds("word/"), F.lit("word")).when(holds("xl/"), F.lit("excel")).when(holds("ppt/"), F.lit("ppt")).otherwise(F.lit("unknown"))
    return F.when(names.isNull(), F.lit("corrupted")).otherwise(kind)


@lazy_udf("struct<eml:boolean,text:boolean>")
def _text_kind(header: pd.Series, whole: pd.Series) -> pd.DataFrame:
    rows = [{"eml": False, "text": False} if h is None else {"eml": looks_like_eml(h), "text": looks_like_text(h, bool(w))} for h, w in zip(header, whole)]
    return pd.DataFrame(rows, columns=["eml", "text"])


def looks_like_eml(header: bytes) -> bool:
    """At least three of the first twenty lines begin with a mail header's name."""
    lines = header.decode("utf-8", errors="ignore").splitlines()[:20]
    return sum(line.startswith(EML_MARKERS) for line in lines) >= 3


def looks_like_text(header: bytes, whole: bool = True) -> bool:
    """No NUL, and decodable as UTF-8 or Big5.

    A header that ends inside a character because it was cut still is text; ``whole`` says that
    nothing was cut, so that an incomplete character at the end counts as a fault.
    """
    if b"\0" in header:
        return False
    for encoding in ("utf-8", "big5", "cp950"):
        for cut in range(1 if whole else 4 if encoding == "utf-8" else 2):
            try:
                header[: len(header) - cut].decode(encoding)
                return True
            except UnicodeDecodeError:
                continue
    return False


def detect_type(content: Column, path: Column, strict: bool = False) -> Column:
    """The document type from content; 'corrupted' for a broken container, 'empty' for no bytes.

    PDFs come out as pdf_digital until their pages are seen (``classify_pdf``). ``strict`` keeps the
    stricter reading of text headers cut inside a character.
    """
    header = F.substring(content, 1, HEADER_BYTES)
    whole = F.lit(True) if strict else F.length(content) <= HEADER_BYTES
    is_zip = F.startswith(content, _bytes(ZIP))
    is_ole = F.startswith(content, _bytes(OLE))
    is_pdf = F.contains(F.substring(content, 1, 1024), _bytes(PDF))
    kind = _text_kind(header, whole)
    return (
        F.when(F.length(content) == 0, F.lit("empty"))
        .when(is_pdf, F.lit("pdf_digital"))
        .when(is_zip, classify_zip(zip_names(F.when(is_zip, content))))
        .when(is_ole & (suffix(path) == "msg"), F.lit("email"))
        .when(is_ole, F.lit("legacy_office"))
        .when(image_magic(content), F.lit("image"))
        .when(kind["eml"], F.lit("email"))
        .when(kind["text"], F.lit("text"))
        .otherwise(F.lit("unknown"))
    )


def coverage_type(coverage: Column, digital: float = 0.8, scanned: float = 0.1) -> Column:
    """The kind of a PDF by the share of its pages that have text; null without pages."""
    return F.when(coverage >= digital, F.lit("pdf_digital")).when(coverage <= scanned, F.lit("pdf_scanned")).when(coverage.isNotNull(), F.lit("pdf_mixed"))


def classify_pdf(page_texts: Column, least: int = 50, sample: int = 30, digital: float = 0.8, scanned: float = 0.1) -> Column:
    """Kind of a PDF from its pages' texts: pages with at least ``least`` characters among the first ``sample``."""
    from ..functions.text import strip

    first = F.slice(page_texts, 1, sample)
    texts = F.size(F.filter(first, lambda t: F.length(strip(F.coalesce(t, F.lit("")))) >= least))
    coverage = F.when(F.size(first) > 0, texts / F.size(first))
    return F.coalesce(coverage_type(coverage, digital, scanned), F.lit("corrupted"))

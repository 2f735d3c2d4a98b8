"""Listing of input files. A manifest rather than a binary scan: empty files and names that begin with
'_' or '.' must be reported too, and a file that is too large must not be read."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MESSAGES
from ..operators.routing import SUFFIXES, size_error
from ..session import cut_lineage, ship_package
from .frames import in_frames
from .storage import filesystem, read_bytes

SCHEMA = "ord bigint, file string, file_name string, length bigint"
_ENTRY = "kind string, file string, file_name string, length bigint"


def _entries(folder: str) -> Iterator[tuple[str, str, str, int]]:
    """Folders, and files with a known suffix, that lie directly in a folder."""
    system, inner, before = filesystem(folder)
    for info in system.get_file_info(fs.FileSelector(inner)):
        if info.type == fs.FileType.Directory:
            yield "folder", before + info.path, info.base_name, 0
        elif info.type == fs.FileType.File and PurePosixPath(info.base_name).suffix.lower().lstrip(".") in SUFFIXES:
            yield "file", before + info.path, info.base_name, info.size


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split(" ")[0] for part in _ENTRY.split(", ")]
    for batch in batches:
        for folder in batch["file"]:
            yield pd.DataFrame(list(_entries(folder)), columns=columns)


def manifest(spark: SparkSession, path: str | Path) -> DataFrame:
    """ord, file, file_name, length of the files with a known suffix below a folder; a path to a file is taken as it is.

    Folders are listed by the executors, a level of the tree at a time; the driver holds no list. ``ord``
    follows the order of the paths, folder by folder; it is not without gaps. A missing path lists nothing.
    """
    ship_package(spark)
    system, inner, before = filesystem(str(path))
    info = system.get_file_info([inner])[0]
    if info.type == fs.FileType.File:
        return spark.createDataFrame([(0, before + inner, info.base_name, info.size)], SCHEMA)
    files = spark.createDataFrame([], _ENTRY)
    folders = spark.createDataFrame([(before + inner,)] if info.type == fs.FileType.Directory else [], "file string")
    while not folders.isEmpty():
        cores = spark.sparkContext.defaultParallelism
        level = cut_lineage(folders.select("file").repartition(cores).mapInPandas(_list_folders, _ENTRY))
        files, folders = files.union(level.filter("kind = 'file'")), level.filter("kind = 'folder'")
    ordered = files.orderBy(F.split("file", "/")).withColumn("ord", F.monotonically_increasing_id())
    return ordered.select("ord", "file", "file_name", "length")


CHECKED = SCHEMA + ", error_code string, error string, content binary"


def with_content(files: DataFrame, max_mb: float = 200) -> DataFrame:
    """Adds error_code, error and content; only files that pass the checks on their size are read.

    One narrow pass: the listing decides what is read, and each task reads its files.
    (The binary source would leave out hidden names and empty files.)
    """
    problem = size_error(F.col("length"), max_mb)
    checked = files.select("ord", "file", "file_name", "length", problem["code"].alias("error_code"), problem["message"].alias("error"))
    return checked.mapInPandas(_read_files, CHECKED)


def _read_one(row: dict) -> dict:
    if row["error_code"] is not None:
        return row | {"content": None}
    try:
        return row | {"content": read_bytes(row["file"])}
    except OSError as fault:
        return row | {"content": None, "error_code": "corrupted", "error": f"{MESSAGES['corrupted']}（{fault.strerror or type(fault).__name__}）"}


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ("ord", "file", "file_name", "length", "error_code", "error", "content")
    for batch in batches:
        yield from in_frames(map(_read_one, batch.to_dict("records")), columns, lambda row: len(row["content"] or b""))

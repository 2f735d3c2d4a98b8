"""Where results go. Everything is written by the executors."""

from __future__ import annotations

import shutil
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import filesystem, write_bytes


def write_results(results: DataFrame, path: str, partition_by: str = "status") -> None:
    """The results as Parquet, keyed by full path, partitioned for the reports."""
    results.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def markdown_name(file: str, root: str = "") -> str:
    """The output of a file, below the output folder: its place below ``root``, whole name and all.

    Names keep their suffix, so that ``a.txt`` and ``a.csv`` keep apart as ``a.txt.md`` and ``a.csv.md``, and
    their folders, so that equal names in different folders do. Two files never share an output.
    """
    inside = file[len(root) :] if root and file.startswith(root.rstrip("/") + "/") else file.partition("://")[2] or file
    return "/".join(part for part in inside.split("/") if part not in ("", ".", "..")) + ".md"


def write_markdown(results: DataFrame, folder: str | Path, root: str | Path = "") -> int:
    """One Markdown file for each success, named by ``markdown_name``; how many there are."""
    system, inner, before = filesystem(str(folder))
    below, out = (lambda found: found[2] + found[1])(filesystem(str(root))) if str(root) else "", before + inner

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            for file, text in zip(batch["file"], batch["display_text"]):
                write_bytes(f"{out}/{markdown_name(file, below)}", (text or "").encode("utf-8", "replace"), attempt)
            yield pd.DataFrame({"n": [len(batch)]})

    system.create_dir(inner, recursive=True)
    good = results.filter("status = 'success'").select("file", "display_text")
    return good.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_lines(lines: DataFrame, folder: str) -> None:
    """The lines of a report in their order, as text files whose names follow it."""
    lines.orderBy("section", "ord", "part").select("line").write.mode("overwrite").option("lineSep", "\n").text(folder)


def join_parts(folder: str | Path, path: str | Path) -> None:
    """The parts of a local text output as one file, copied a piece at a time."""
    with open(path, "wb") as out:
        for part in sorted(Path(folder).glob("part-*")):
            with part.open("rb") as source:
                shutil.copyfileobj(source, out)


def write_csv(table: DataFrame, path: str) -> None:
    """A report table as CSV with a header."""
    table.write.mode("overwrite").option("header", True).csv(path)


def exploded_findings(results: DataFrame, findings: str = "findings") -> DataFrame:
    """A row for each finding, for the findings table."""
    return results.select("file", F.explode(findings).alias("f")).select("file", "f.*")

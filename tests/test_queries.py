"""Every registered core query against its oracle on the smallest tables; no oracle may be trivial."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from foliospark.plans import queries

#: Queries whose rows all agree by construction.
UNIFORM = {"mask_keep", "audit_hash", "latest_results", "batch_summary", "findings_by_type"}


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or str(type(value)).find("bool") >= 0:
        return bool(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return round(float(value), 8)
    return str(pd.Timestamp(value)) if hasattr(value, "isoformat") else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(tiny):
    connection = duckdb.connect()
    for path in Path(tiny).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, tiny, duck, name):
    found = queries.QUERIES[name](spark, tiny).toPandas()
    assert len(found) > 0
    if name in queries.ORACLES:
        expected = duck.execute(queries.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)


def test_detection_queries_find_something_and_not_everything(spark, tiny):
    for name in ("detect_email", "detect_bank", "detect_company", "detect_tw_id", "detect_passport"):
        counts = queries.QUERIES[name](spark, tiny).toPandas()["n"]
        assert 0 < (counts > 0).sum() < len(counts), name


def test_audit_verify_equals_fold(spark, tiny):
    from .test_operators import fold

    lines = pd.read_parquet(Path(tiny) / "audit_lines.parquet").drop_duplicates(["log_name", "line_no"]).sort_values("line_no")
    found = queries.QUERIES["audit_verify"](spark, tiny).toPandas().set_index("log_name")
    for name, log in lines.groupby("log_name"):
        _, kind = fold(list(log["raw"]))
        assert found.loc[name, "ok"] == (kind is None) and (kind is None or found.loc[name, "fault"] == kind)


def test_entry(spark, tiny):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

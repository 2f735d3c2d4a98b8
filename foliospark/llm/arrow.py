"""Arrow-batch plumbing shared by the text operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows turned into Python objects at a time. Only bounds a worker's memory; every row is handled.
SLICE_ROWS = 512


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The batch's rows as tuples of Python values, a slice at a time."""
    for start in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(start, SLICE_ROWS)
        yield from zip(*(column.to_pylist() for column in part.columns))


def map_rows(df: DataFrame, fn: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str, flush: int = 4096) -> DataFrame:
    """``fn`` gets the rows of a whole partition as one stream of tuples and yields output tuples.

    The stream lets ``fn`` keep state for its partition (caches, counters) and emit at the end.
    """
    struct: StructType = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(struct)

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

        out: list[tuple] = []
        for row in fn(row for batch in batches for row in rows_of(batch)):
            out.append(row)
            if len(out) >= flush:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    return df.mapInArrow(run, struct)


def broadcast(df: DataFrame, value):
    """Broadcast a driver-side value whose size is bounded by its own definition (see each caller)."""
    context: SparkContext = df.sparkSession.sparkContext
    return context.broadcast(value)


def quiet(value, default=""):
    """``value`` unless null."""
    return default if value is None else value


@contextlib.contextmanager
def no_gc():
    """Long runs of small objects trigger useless collections; the operators build no cycles."""
    import gc

    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()

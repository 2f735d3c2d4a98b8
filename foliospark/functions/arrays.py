"""Expressions over arrays that Spark lacks, as SQL text and as columns.

Nested array functions are written as SQL: one call hands a whole expression to the parser, where the
column functions would go to the JVM and back for every node of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of a running fold.
BLOCK = 64


def literal(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def applied(value: Column, body: str, name: str = "t") -> Column:
    """SQL text over a value bound to ``name``: the value is computed once, however often the text names it."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def bound(value: str, name: str, body: str) -> str:
    """The same within SQL text."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running_sql(values: str, op: Callable[[str, str], str]) -> str:
    """The fold of ``op`` over the elements up to each one, for an associative ``op`` on integers; null for null.

    A fold that appends to its result copies it at every step. Beyond one block only the folds of whole
    blocks are appended, and a step within a block looks at the block alone.
    """

    def steps(part: str) -> str:
        grown = f"concat(ra, array({op('ra[size(ra) - 1]', 'CAST(rx AS BIGINT)')}))"
        return f"aggregate(slice({part}, 2, size({part})), CAST(slice({part}, 1, 1) AS array<bigint>), (ra, rx) -> {grown})"

    fold = f"aggregate(slice(rb, 2, size(rb)), CAST(rb[0] AS BIGINT), (ra, rx) -> {op('ra', 'CAST(rx AS BIGINT)')})"
    later = bound(steps("rb"), "ro", f"transform(ro, rx -> {op('get(rt, rk - 1)', 'rx')})")
    blocks = f"transform(sequence(0, CAST(floor((size(rv) - 1) / {BLOCK}) AS INT)), rk -> slice(rv, rk * {BLOCK} + 1, {BLOCK}))"
    joined = bound(steps("rs"), "rt", f"flatten(transform(rp, (rb, rk) -> CASE WHEN rk = 0 THEN {steps('rb')} ELSE {later} END))")
    many = bound(blocks, "rp", bound(f"transform(rp, rb -> {fold})", "rs", joined))
    return bound(values, "rv", f"CASE WHEN size(rv) < 1 THEN CAST(array() AS array<bigint>) WHEN size(rv) <= {BLOCK} THEN {steps('rv')} WHEN rv IS NOT NULL THEN {many} END")


def running(values: Column, op: Callable[[str, str], str]) -> Column:
    """``running_sql`` of a column."""
    return applied(values, running_sql("rw", op), "rw")

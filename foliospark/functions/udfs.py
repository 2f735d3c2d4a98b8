"""Arrow functions that are built when first used, so that modules import without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lazy_udf(returns: str) -> Callable:
    """Decorator: a pandas function as a column function of the given DDL type."""

    def wrap(fn: Callable) -> Callable[..., Column]:
        @functools.cache
        def built():
            return F.pandas_udf(fn, returns)

        @functools.wraps(fn)
        def call(*columns) -> Column:
            return built()(*columns)

        return call

    return wrap

"""Python functions over columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(ddl: str) -> Callable[[Callable], Callable[..., Column]]:
    """A column function of the given return type; it is built when called, as types need a session."""

    def make(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.udf(f, ddl, useArrow=True)(*columns)

        return call

    return make

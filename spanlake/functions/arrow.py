"""Arrow functions that are made when a plan is, so modules import without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(schema: str) -> Callable:
    """A pandas UDF of the annotated function, returning schema (DDL)."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        return call

    return wrap

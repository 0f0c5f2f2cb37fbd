"""Functions over pandas batches as Column functions. The UDF is made at the call: modules load without a session, as on executors."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap

"""Name an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body uses it.

    A Python variable used twice in an expression is two copies of its tree; inside
    a higher-order function Spark evaluates both. A lambda parameter is one value.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]

"""Name an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_BUILT: dict[tuple[str, str], Column] = {}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once.

    Writing a sub-expression several times makes the expression tree grow
    exponentially as functions nest. Binding it to the variable of a one-element
    `transform` keeps the tree linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def built_once(name: str, build: Callable[[], Column]) -> Column:
    """Reuse a large column expression within a Spark application.

    Building one takes thousands of calls into the JVM. `build` must depend on nothing
    but column names.
    """
    context = SparkContext._active_spark_context
    key = (context.applicationId, name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]

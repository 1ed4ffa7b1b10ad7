"""Decimal rounding that depends only on the exact value of the double.

Spark's `round` works on the shortest decimal text and sends ties up. Scores here
need the correctly rounded, ties-to-even result, so that equal inputs rank the
same wherever they are computed. The test against the midpoint is exact: the
value is split into two halves whose products with the scale have no error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelore.functions.binding import let

SPLITTER = 134217729.0  # 2**27 + 1: splits a double into two 26-bit halves


def round_exact(x: Column, digits: int = 6) -> Column:
    scale = F.lit(10.0**digits)
    splitter = F.lit(SPLITTER)

    def halves(v: Column) -> Column:
        high = v * splitter - (v * splitter - v)
        return F.struct(
            F.floor(v * scale).cast("double").alias("below"),
            high.alias("high"),
            (v - high).alias("low"),
        )

    def rounded(h: Column) -> Column:
        below = h["below"]
        over = (h["high"] * scale - (below + F.lit(0.5))) + h["low"] * scale
        is_odd = F.pmod(below, F.lit(2.0)) == 1.0
        return (
            F.when(over > 0, below + 1.0)
            .when((over == 0) & is_odd, below + 1.0)
            .otherwise(below)
            / scale
        )

    return let(let(x, halves), rounded)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

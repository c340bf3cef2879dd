"""Registry of named queries: each Spark query with its SQL oracle.

A query takes ``(spark, sf_dir)`` and returns a DataFrame.  Double columns
listed in ``doubles`` are rounded to ``digits`` on both sides so that sums
taken in a different order compare equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Values that end exactly on a 5 past the kept digits (common for means of
# two-decimal prices) would round by float noise; a nudge on both sides, far
# above the noise (relative 1e-15) and far below the kept digits, moves them
# off the tie: x * (1 + 1e-11) + 1e-11.
NUDGE = 1e-11


def rounded(x: Column, digits: int) -> Column:
    """``round(x, digits)``, digit by digit the same, without a decimal per value where none is needed.

    The product is off by under 1e-15 of itself, so away from a tie the nearest whole number is the right one, and its
    quotient is the double nearest to that decimal.  Ties, large and non-finite values take ``round``.
    """
    unit = F.lit(float(10**digits))
    scaled = x * unit
    whole = F.rint(scaled)
    plain = F.abs(scaled - whole) + F.abs(scaled) * 1e-15 < 0.499
    return F.when(plain, whole / unit).otherwise(F.round(x, digits))


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple = ()
    digits: int = 6
    fine: tuple = ()  # columns compared to six digits whatever ``digits`` says
    notes: str = ""
    tags: tuple = field(default_factory=tuple)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.fn(spark, sf_dir)
        for c in self.doubles:
            df = df.withColumn(c, rounded(F.col(c) * F.lit(1.0 + NUDGE) + F.lit(NUDGE), self._digits(c)) + F.lit(0.0))
        return df

    def _digits(self, column: str) -> int:
        return max(6, self.digits) if column in self.fine else self.digits

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.doubles:
            return self.sql
        rep = ", ".join(
            f"round({c} * CAST({1.0 + NUDGE!r} AS DOUBLE) + CAST({NUDGE!r} AS DOUBLE), {self._digits(c)}) + 0.0 AS {c}"
            for c in self.doubles
        )
        return f"SELECT * REPLACE ({rep}) FROM (\n{self.sql}\n) _q"


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, doubles=(), digits: int = 6, notes: str = "", fine=()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, tuple(doubles), digits, tuple(fine), notes)
        return fn

    return deco

"""Small helpers for building Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIGINT_MIN = -(2**63)
BIGINT_MAX = 2**63 - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``.

    Inside a higher-order function Spark has no common-subexpression
    elimination, so a value used twice would be computed twice.
    """
    return F.transform(F.array(value), body).getItem(0)


def strict_bigint(text: Column) -> Column:
    """Base-10 64-bit integer, NULL for anything else (blanks included)."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def int_div(x: Column, by: int) -> Column:
    """Integer division without a detour through double."""
    return F.call_function("div", x, F.lit(by).cast("bigint"))


def keep_rows(df: DataFrame, condition: Column, columns: list[Column]) -> DataFrame:
    """Filter and project in one step, computing the inputs once.

    A filter on a computed column is pushed below the projection, which then
    computes the column a second time: too dear when it is a parsed document.
    """
    row = F.array(F.struct(*columns))
    return df.select(F.explode(F.when(condition, row)).alias("row")).select("row.*")

"""Number hygiene (P-01, F-13, F-14, F-38 to F-41)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column | str) -> Column:
    """P-01: double, with text that is no number, NaN and infinities as NULL."""
    c = F.col(x) if isinstance(x, str) else x
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL on a zero denominator."""
    return F.try_divide(a, b)


def clip(x: Column, low: float, high: float) -> Column:
    """F-14: NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def half_even(x: Column, digits: int = 0) -> Column:
    """F-13: rounding to the even neighbour."""
    return F.bround(x, digits)


def truthy(x: Column) -> Column:
    """F-39: 'true' and 'false' in any case; anything else NULL."""
    s = F.lower(F.trim(x.cast("string")))
    return F.when(s == "true", True).when(s == "false", False)


def quality_code(x: Column) -> Column:
    """F-40: POOR, LIMITED, GOOD as 0, 1, 2."""
    return F.when(x == "POOR", 0.0).when(x == "LIMITED", 1.0).when(x == "GOOD", 2.0)


def units_up(x: Column, scale: float) -> Column:
    """F-41: demand in whole units, rounded up."""
    return F.ceil(x * scale).cast("long")


def units_down(x: Column, scale: float) -> Column:
    """F-41: capacity in whole units, rounded down."""
    return F.floor(x * scale).cast("long")


def rounded(x: Column, digits: int) -> Column:
    """To digits after the point as SQL engines do it: by the nearest whole number of units. Spark's own round looks at the decimal text, which differs for values next to a half."""
    return F.round(x * 10.0**digits) / 10.0**digits

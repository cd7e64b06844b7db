"""Display formats and exact rounding of ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def thousands(col: Column) -> Column:
    """Integer with points between the thousands."""
    return F.translate(F.format_number(col, 0), ",", ".")


def percentage(part: Column, total: Column) -> Column:
    """Share with one decimal and a comma; "0%" of an empty total."""
    tenths = F.floor(F.try_divide(F.lit(100.0) * part, total) * 10 + 0.5).cast("bigint")
    text = F.concat(
        (F.floor(tenths / 10)).cast("bigint").cast("string"),
        F.lit(","),
        (tenths % 10).cast("string"),
        F.lit("%"),
    )
    return F.when((total == 0) | total.isNull(), F.lit("0%")).otherwise(text)


def whole_percent(ratio: Column) -> Column:
    """Ratio as a whole percentage, ties to even."""
    return F.concat(F.rint(ratio * 100).cast("bigint").cast("string"), F.lit("%"))


def round_ratio(num: Column, den: Column, digits: int) -> Column:
    """``num / den`` rounded like a correctly rounded double.

    ``num`` and ``den`` are whole numbers. Ties are settled by the side on which
    the double of the quotient lies, and to even when it is exact; plain decimal
    rounding of the printed double gets some of them wrong.
    """
    num, den = num.cast("bigint"), den.cast("bigint")
    # Whole numbers are exact as they are; only a tie, which is rare, takes wide decimals.
    scaled = num * F.lit(10**digits).cast("bigint")
    rest = F.try_mod(scaled, den)
    low = F.try_divide((scaled - rest).cast("double"), den.cast("double")).cast("bigint")
    value = F.try_divide(num.cast("double"), den.cast("double"))
    bits = F.when(value < 1, F.lit(2.0**60)).otherwise(F.lit(2.0**55))
    exact = (value * bits).cast("bigint").cast("decimal(20,0)") * den.cast("decimal(10,0)")
    side = exact - num.cast("decimal(16,0)") * bits.cast("bigint").cast("decimal(20,0)")
    odd = (low % 2) == 1
    up = (
        F.when(rest * 2 > den, True)
        .when(rest * 2 < den, False)
        .when(side > 0, True)
        .when(side < 0, False)
        .otherwise(odd)
    )
    whole = F.when(up, low + 1).otherwise(low)
    return whole.cast("double") / F.lit(float(10**digits))

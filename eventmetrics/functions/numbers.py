"""Percentages and number texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` as double, 0.0 when ``whole`` is 0."""
    whole = whole.cast("double")
    return F.coalesce(part.cast("double") * 100.0 / F.nullif(whole, F.lit(0.0)), F.lit(0.0))


def percent_change(current: Column, prior: Column) -> Column:
    """Change against the prior period in percent, 2 decimals.

    From zero, any growth counts as 100 and no growth as 0.
    """
    current, prior = current.cast("double"), prior.cast("double")
    from_zero = F.when(current > 0.0, 100.0).otherwise(0.0)
    return F.when(prior == 0.0, from_zero).otherwise(
        F.round((current - prior) / prior * 100.0, 2)
    )


def double_text(value: Column) -> Column:
    """Shortest text of a double: plain digits from 1e-4 up to 1e16, else an exponent of two digits or more.

    Whole numbers keep ``.0`` in plain digits.
    """
    text = value.cast("string")
    # 17 digits at most, of which 16 stand before the point or 20 behind it.
    digits = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(exponent < 0, "-").otherwise("+")
    power = F.format_string("%02d", F.abs(exponent))
    size = F.abs(value)
    return (
        F.when(value == 0, text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(text.contains("E"), F.concat(mantissa, F.lit("e"), sign, power))
        .otherwise(text)
    )

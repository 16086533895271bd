"""Labels and display texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventmetrics.functions.numbers import double_text


def slug_base(name: Column) -> Column:
    """Lower case, only ``a-z 0-9`` and single inner hyphens; empty becomes ``org``."""
    kept = F.regexp_replace(F.lower(name), r"(?U)[^a-z0-9\s-]", "")
    joined = F.regexp_replace(kept, r"(?U)[\s-]+", "-")
    trimmed = F.regexp_replace(joined, r"^-+|-+$", "")
    return F.when(trimmed == "", F.lit("org")).otherwise(trimmed)


def metric_title(metric: Column) -> Column:
    return F.initcap(F.replace(metric, F.lit("_"), F.lit(" ")))


def unit_suffix(metric: Column) -> Column:
    return (
        F.when(F.contains(metric, F.lit("rate")), F.lit("%"))
        .when(F.contains(metric, F.lit("duration")), F.lit("s"))
        .otherwise(F.lit(""))
    )


def signed_text(change: Column) -> Column:
    sign = F.when(change >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, double_text(change), F.lit("%"))


def duration_text(seconds: Column) -> Column:
    """``42s`` below a minute, else ``3m 5s``; halves round up."""

    def rounded(value: Column) -> Column:
        return F.floor(value + 0.5).cast("bigint").cast("string")

    minutes = F.floor(seconds / 60.0).cast("bigint").cast("string")
    rest = rounded(seconds - F.floor(seconds / 60.0) * 60.0)
    return F.when(seconds < 60.0, F.concat(rounded(seconds), F.lit("s"))).otherwise(
        F.concat(minutes, F.lit("m "), rest, F.lit("s"))
    )


def trend(change: Column, lower_is_better: Column | bool = False) -> Column:
    """``flat``, ``good`` or ``bad``; for a bounce rate going down is good."""
    lower = F.lit(lower_is_better) if isinstance(lower_is_better, bool) else lower_is_better
    good = F.when(lower, change < 0).otherwise(change > 0)
    return F.when(change == 0, "flat").when(good, "good").otherwise("bad")

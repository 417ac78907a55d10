"""Small value expressions used across reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name of the row-count column of a pre-aggregated capture frame.
WEIGHT = "capture_count"


def rows_of(df: DataFrame) -> Column:
    """Aggregate that counts captures.

    A plain capture frame has one row per capture; a frame made by
    :func:`surtscope.operators.rollups.compact` carries its count in
    ``capture_count``. Reports written with this run on both.
    """
    if WEIGHT in df.columns:
        return F.sum(WEIGHT)
    return F.count(F.lit(1))


def rows_where(df: DataFrame, condition: Column) -> Column:
    """Aggregate that counts the captures meeting a condition, 0 if none."""
    if WEIGHT in df.columns:
        return F.coalesce(F.sum(F.when(condition, F.col(WEIGHT))), F.lit(0).cast("long"))
    return F.count_if(condition)


def ratio_pct(part: Column, whole: Column, digits: int) -> Column:
    """``100 * part / whole`` in doubles, rounded; NULL for an empty whole."""
    hundred = F.lit(100.0).cast("double")
    return F.round(hundred * part / F.nullif(whole, F.lit(0)), digits)


def duplication_pct(distinct: Column, whole: Column, digits: int) -> Column:
    """Share of rows that repeat an earlier value."""
    hundred = F.lit(100.0).cast("double")
    share = distinct.cast("double") / F.nullif(whole, F.lit(0))
    return F.round(hundred * (F.lit(1.0).cast("double") - share), digits)


def rint_digits(x: Column, digits: int) -> Column:
    """Round a double to ``digits`` places, ties to even after scaling."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale


def share_pct(part: Column, whole: Column, digits: int | None = None) -> Column:
    """``part / whole * 100`` as the wide report frames compute it."""
    pct = part / F.nullif(whole, F.lit(0)) * F.lit(100.0)
    return pct if digits is None else rint_digits(pct, digits)


def to_bigint(x: Column) -> Column:
    """Double to bigint, ties to even."""
    return F.rint(x).cast("bigint")


def status_class(status: Column | str = "status") -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return (
        F.when(s.between(200, 299), "2xx")
        .when(s.between(300, 399), "3xx")
        .when(s.between(400, 499), "4xx")
        .when(s.between(500, 599), "5xx")
        .otherwise("other")
    )


STATUS_CLASSES = ["2xx", "3xx", "4xx", "5xx", "other"]


def occurrence_bucket(n: Column) -> Column:
    return (
        F.when(n == 1, "1 (seen once)")
        .when(n <= 5, "2-5")
        .when(n <= 20, "6-20")
        .otherwise("20+")
    )


def month_of(timestamp: Column | str) -> Column:
    """``yyyymm`` of a 14-digit capture time."""
    return F.substring(timestamp, 1, 6)


def composite(*parts: Column) -> Column:
    """Key joined by ``|``; NULL as soon as one part is NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit("|"), p)
    return out

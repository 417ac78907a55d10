"""Comparing two sources of the same captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_diff(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_n: str,
    right_n: str,
    missing_as_zero: bool = True,
    diff: str = "diff",
) -> DataFrame:
    """Full outer join of two count frames with ``right - left``.

    ``missing_as_zero`` fills absent sides with 0; otherwise a one-sided key
    keeps its NULL count and a NULL difference.
    """
    joined = left.join(right, keys, "full_outer")
    if missing_as_zero:
        joined = joined.na.fill(0, subset=[left_n, right_n])
    return joined.withColumn(diff, F.col(right_n) - F.col(left_n))


def largest_gap_first(diffs: DataFrame, *ties: str, diff: str = "diff") -> DataFrame:
    return diffs.orderBy(F.abs(F.col(diff)).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties])


def _same_key(left: str, right: str, keys: list[str]):
    """Equal keys; NULL parts count as equal, so that a second run adds nothing."""
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def absent_from(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``."""
    seen = other.select(*keys).alias("seen")
    return df.alias("new").join(seen, _same_key("seen", "new", keys), "left_anti")


def with_keys_of(other: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of a huge ``other`` that occur in a smaller ``df``.

    Cuts ``other`` down in the tasks that scan it, as long as the keys of
    ``df`` are small enough for Catalyst to broadcast; beyond that both sides
    are shuffled.
    """
    wanted = df.select(*keys).distinct().alias("wanted")
    return other.select(*keys).alias("all").join(wanted, _same_key("all", "wanted", keys), "left_semi")

"""Counting by year, shares of a total, top-k and remainders.

Each helper aggregates before anything is shuffled, and no window ever spans
a whole frame: totals are one-row scalar subqueries, and rankings filter on
``row_number() <= k`` so that Spark cuts every partition to k rows per group
before the exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surtscope.config import CRAWL_YEARS
from surtscope.functions.measures import WEIGHT, ratio_pct, rows_of, rows_where, share_pct


#: Above this k, the default of ``spark.sql.optimizer.windowGroupLimitThreshold``,
#: groups are ranked in slices first.
_SLICED_ABOVE = 1000
_SLICES = 64


def compact(captures: DataFrame, keys: list[str]) -> DataFrame:
    """Pre-aggregate captures to one row per key with ``capture_count``.

    Reports that only count can run on this much smaller frame, so that one
    scan of the captures serves many of them.
    """
    return captures.groupBy(*keys).agg(rows_of(captures).alias(WEIGHT))


def years_in(df: DataFrame, year: str = "crawl_year") -> list[str]:
    """The crawl years that occur, oldest first: a handful, read from partition values."""
    return [r[0] for r in df.select(year).where(F.col(year).isNotNull()).distinct().orderBy(year).collect()]


def count_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(rows_of(df).alias(name))


def most_frequent_first(counts: DataFrame, n: str, *ties: str) -> DataFrame:
    return counts.orderBy(F.col(n).desc(), *[F.col(t).asc_nulls_last() for t in ties])


def year_pivot(
    df: DataFrame,
    keys: list[str],
    years=CRAWL_YEARS,
    year: str = "crawl_year",
    total: str | None = "total",
) -> DataFrame:
    """One count column per year and the count of all rows, in a single aggregation.

    ``total`` also counts rows of years that are not listed, or of none.

    The year list is given, so an absent year is a column of zeros and the
    schema never depends on the data. Conditional counts share one exchange;
    a two-step pivot would need two.
    """
    per_year = [rows_where(df, F.col(year) == y).alias(y) for y in years]
    if total:
        per_year.append(rows_of(df).alias(total))
    return df.groupBy(*keys).agg(*per_year)


def row_sum(columns) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def pivot_values(df: DataFrame, keys: list[str], column: str, values: list, measure: str) -> DataFrame:
    """Long to wide for an already aggregated measure, missing cells 0."""
    wide = df.groupBy(*keys).pivot(column, list(values)).agg(F.sum(measure))
    return wide.na.fill(0, subset=[str(v) for v in values])


def row_percentages(wide: DataFrame, columns: list[str], digits: int | None = None) -> DataFrame:
    """Replace counts by their percentage of the row total."""
    total = row_sum(columns)
    return wide.withColumns({c: share_pct(F.col(c), total, digits) for c in columns})


def with_share(counts: DataFrame, n: str, name: str = "pct", digits: int = 2) -> DataFrame:
    """Share of the grand total, the total being a one-row subquery."""
    whole = counts.agg(F.sum(n)).scalar()
    return counts.withColumn(name, ratio_pct(F.col(n), whole, digits))


def top_k(df: DataFrame, k: int, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """First k rows, overall or per group.

    Spark cuts groups to k rows before the exchange only for a small k; a larger one
    is first ranked within slices of a group, so that no task sorts a whole group.
    """
    if not within:
        return df.orderBy(*order).limit(k)
    if k > _SLICED_ABOVE:
        columns = df.columns
        slice_of = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(_SLICES))
        sliced = Window.partitionBy(*within, "_slice").orderBy(*order)
        first = df.withColumn("_slice", slice_of).withColumn("_rank", F.row_number().over(sliced))
        df = first.where(F.col("_rank") <= k).select(*[F.col(f"`{c}`") for c in columns])
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def tail_as(
    counts: DataFrame,
    label: str,
    k: int,
    n: str = "n",
    rest: str = "other",
    within: list[str] | None = None,
) -> DataFrame:
    """Keep the k labels with most captures, rename all others to ``rest``.

    Other columns stay; the caller aggregates again. The label totals are an
    aggregate of ``counts`` and only k of them per group reach the join.
    """
    within = within or []
    totals = counts.groupBy(*within, label).agg(F.sum(n).alias("_total"))
    leaders = top_k(
        totals, k, [F.col("_total").desc(), F.col(label).asc_nulls_last()], within
    ).select(*within, label, F.lit(True).alias("_leads"))
    joined = counts.join(leaders, [*within, label], "left")
    return joined.withColumn(
        label, F.when(F.col("_leads"), F.col(label)).otherwise(F.lit(rest))
    ).drop("_leads")


def top_k_with_rest(
    totals: DataFrame,
    label: str,
    k: int,
    n: str = "total",
    rest: str = "(other)",
    within: list[str] | None = None,
) -> DataFrame:
    """Top k labels plus one row with the sum of all others (0 if there are none)."""
    within = within or []
    top = top_k(totals, k, [F.col(n).desc(), F.col(label).asc_nulls_last()], within)
    top = top.select(*within, label, n)
    # sum of all minus sum of the leaders, as one aggregate of signed rows
    signed = totals.select(*within, F.col(n).alias("_n")).unionByName(
        top.select(*within, (-F.col(n)).alias("_n"))
    )
    remainder = signed.groupBy(*within).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(n))
    remainder = remainder.select(*within, F.lit(rest).alias(label), n)
    return top.unionByName(remainder)


def distinct_per_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct count of every column (NULL not counted), one row.

    Many ``count(DISTINCT …)`` in one aggregate would copy each wide row once
    per column. Here a row turns into narrow (column, value) pairs that are
    combined before the shuffle.
    """
    columns = columns or df.columns
    pairs = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("pair")
    ).select("pair.column", "pair.value")
    distinct = pairs.where(F.col("value").isNotNull()).distinct()
    per_column = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    return per_column.agg(
        *[
            F.coalesce(F.max(F.when(F.col("column") == i, F.col("n"))), F.lit(0)).alias(c)
            for i, c in enumerate(columns)
        ]
    )


def with_year_totals(long: DataFrame, keys: list[str], year: str, n: str) -> DataFrame:
    """Add an ``ALL`` row over the years to every key."""
    sets = [[*[F.col(k) for k in keys], F.col(year)], [F.col(k) for k in keys]]
    grouped = long.groupingSets(sets, *[F.col(k) for k in keys], F.col(year)).agg(
        F.sum(n).alias(n), F.grouping(year).alias("_all_years")
    )
    return grouped.withColumn(
        year, F.when(F.col("_all_years") == 1, F.lit("ALL")).otherwise(F.col(year))
    ).drop("_all_years")

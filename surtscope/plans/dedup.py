"""Duplicates, redundancy and persistence of SURT keys.

All reports label each row with its target domain and group by it, so one job
covers every domain. Distinct counts are layered ``groupBy`` steps: each one
combines rows before its shuffle and spreads a domain or a key that holds many
captures over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtscope.config import CRAWL_YEARS, TARGET_DOMAINS
from surtscope.functions.measures import rint_digits
from surtscope.operators import domains as dom
from surtscope.operators import rollups as roll


def _by_domain(captures: DataFrame, domains, *columns: str) -> DataFrame:
    label = dom.target(captures, domains).alias("domain")
    return captures.select(label, *columns).where(F.col("domain").isNotNull())


def duplication(captures: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    """Rows, unique (key, time) pairs and unique keys per domain and year."""
    keys = ["domain", "crawl_year"]
    rows = _by_domain(captures, domains, "crawl_year", "surtkey", "fetch_timestamp")
    per_pair = rows.groupBy(*keys, "surtkey", "fetch_timestamp").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_pair.groupBy(*keys, "surtkey").agg(
        F.sum("n").alias("n"), F.count("fetch_timestamp").alias("pairs")
    )
    totals = per_key.groupBy(*keys).agg(
        F.sum("n").alias("total_rows"),
        F.sum("pairs").alias("unique_surt_ts"),
        F.count(F.lit(1)).alias("unique_surturls"),
    )
    redundancy = F.lit(100.0) * (
        F.lit(1.0) - F.col("unique_surturls") / F.col("total_rows")
    )
    return totals.select(
        *keys,
        "total_rows",
        "unique_surt_ts",
        (F.col("total_rows") - F.col("unique_surt_ts")).alias("true_duplicates"),
        "unique_surturls",
        (F.col("total_rows") - F.col("unique_surturls")).alias("multi_capture"),
        rint_digits(redundancy, 2).alias("redundancy_pct"),
    ).orderBy(*keys)


def total_true_duplicates(duplicates: DataFrame) -> DataFrame:
    return duplicates.agg(
        F.coalesce(F.sum("true_duplicates"), F.lit(0)).alias("true_duplicates"),
        F.count_if(F.col("true_duplicates") > 0).alias("cells_with_duplicates"),
    )


def _heat(duplicates: DataFrame, measure: str, years) -> DataFrame:
    wide = roll.pivot_values(duplicates, ["domain"], "crawl_year", years, measure)
    return (
        wide.withColumn("_order", roll.row_sum(years))
        .orderBy(F.col("_order").desc(), "domain")
        .drop("_order")
    )


def redundancy_heat(duplicates: DataFrame, years=CRAWL_YEARS) -> DataFrame:
    """Redundancy per domain and year, most redundant domain first."""
    return _heat(duplicates, "redundancy_pct", years)


def unique_heat(duplicates: DataFrame, years=CRAWL_YEARS) -> DataFrame:
    return _heat(duplicates, "unique_surturls", years)


def most_captured(captures: DataFrame, domains=TARGET_DOMAINS, k: int = 10) -> DataFrame:
    """The k keys captured most often within one year, per domain."""
    counts = _by_domain(captures, domains, "surtkey", "crawl_year").groupBy(
        "domain", "surtkey", "crawl_year"
    ).agg(F.count(F.lit(1)).alias("captures"))
    order = [F.col("captures").desc(), F.col("surtkey"), F.col("crawl_year")]
    return roll.top_k(counts, k, order, ["domain"]).orderBy("domain", *order)


def most_captured_overall(
    captures: DataFrame, domains=TARGET_DOMAINS, k: int = 20, per_domain: int = 10
) -> DataFrame:
    """The k largest entries of the per-domain lists."""
    lists = most_captured(captures, domains, per_domain)
    order = [F.col("captures").desc(), F.col("domain"), F.col("surtkey"), F.col("crawl_year")]
    return roll.top_k(lists, k, order).select("domain", "crawl_year", "surtkey", "captures")


def year_overlap(captures: DataFrame, domains=TARGET_DOMAINS, years=None) -> DataFrame:
    """How many keys of a domain were seen in exactly 1, 2, … years, and all its keys.

    Only captures of ``years`` count if they are given; else all years that occur do,
    with a column for each, and never fewer columns than there are usual years.
    """
    if years:
        captures = captures.where(F.col("crawl_year").isin(*years))
    n_years = len(years) if years else max(len(CRAWL_YEARS), len(roll.years_in(captures)))
    seen = _by_domain(captures, domains, "surtkey", "crawl_year").distinct()
    per_key = seen.groupBy("domain", "surtkey").agg(F.count("crawl_year").alias("years_present"))
    wide = per_key.groupBy("domain").agg(
        *[F.count_if(F.col("years_present") == i).alias(f"{i} year(s)") for i in range(1, n_years + 1)],
        F.count(F.lit(1)).alias("total_unique_surts"),
    )
    return wide.orderBy(F.col("total_unique_surts").desc(), "domain")


def year_overlap_pct(overlap: DataFrame) -> DataFrame:
    """The counts of :func:`year_overlap` as shares of a domain's keys."""
    columns = [c for c in overlap.columns if c.endswith("year(s)")]
    shares = roll.row_percentages(overlap.select("domain", *columns), columns)
    return shares.orderBy(columns[0], "domain")

"""Totals, rankings and year tables of the captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtscope.config import CRAWL_YEARS, TARGET_DOMAINS
from surtscope.functions import urls
from surtscope.functions.measures import month_of, ratio_pct
from surtscope.operators import domains as dom
from surtscope.operators import rollups as roll

BARE = "(bare/www)"


def overview(captures: DataFrame) -> DataFrame:
    """Rows, distinct hosts and crawl years.

    Counted per (host, year) first: the two distincts then run on that small
    frame instead of copying every capture row.
    """
    small = captures.groupBy("host", "crawl_year").agg(F.count(F.lit(1)).alias("n"))
    return small.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count_distinct("host").alias("distinct_hosts"),
        F.count_distinct("crawl_year").alias("crawl_years"),
    )


def captures_per_host(captures: DataFrame) -> DataFrame:
    return roll.most_frequent_first(roll.count_by(captures, ["host"], "captures"), "captures", "host")


def captures_per_year(captures: DataFrame, name: str = "captures") -> DataFrame:
    return roll.count_by(captures, ["crawl_year"], name).orderBy("crawl_year")


def index_rows_per_year(index: DataFrame) -> DataFrame:
    return captures_per_year(index, "rows")


def host_year_counts(captures: DataFrame) -> DataFrame:
    return roll.most_frequent_first(
        roll.count_by(captures, ["host", "crawl_year"]), "n", "host", "crawl_year"
    )


def surtkey_year_counts(captures: DataFrame) -> DataFrame:
    return roll.most_frequent_first(
        roll.count_by(captures, ["surtkey", "crawl_year"]), "n", "surtkey", "crawl_year"
    )


def surt_sample(captures: DataFrame, hosts: list[str] | None = None, limit: int = 8) -> DataFrame:
    """A few rows with their SURT columns, the same rows every time."""
    rows = captures if hosts is None else captures.where(F.col("host").isin(*hosts))
    return (
        rows.orderBy("surtkey", "fetch_timestamp", "url", "offset")
        .limit(limit)
        .select(
            "host",
            "surthost",
            F.col("surthost_seg_0").alias("tld"),
            F.col("surthost_seg_1").alias("reg_dom"),
            F.col("surthost_seg_2").alias("sub1"),
            F.col("surthost_seg_3").alias("sub2"),
            "surtpath_1",
            "surtpath_2",
        )
    )


def _domain_and_subdomain(df: DataFrame, level: str) -> tuple[Column, Column]:
    """Stored SURT segments when the frame has them, patterns otherwise.

    ``top`` keeps the first label below the domain (``iosst1.ios`` -> ``ios``),
    ``full`` the whole prefix. Without stored segments both mean the full form.
    """
    if level not in ("top", "full"):
        raise ValueError("level must be 'top' or 'full'")
    if level == "top" and {"surthost_seg_0", "surthost_seg_1", "surthost_seg_2"} <= set(df.columns):
        domain = F.concat("surthost_seg_1", F.lit("."), "surthost_seg_0")
        return domain, F.coalesce("surthost_seg_2", F.lit(""))
    return (
        urls.stored_or(df, "reg_domain", urls.registered_domain()),
        urls.stored_or(df, "sub_full", urls.full_subdomain()),
    )


def domain_summary(captures: DataFrame, level: str = "top") -> DataFrame:
    """One row per registered domain: size, subdomains, years, top subdomain.

    Captures are counted once per (domain, subdomain, year); all figures come
    from that small frame, whose exchange both branches share.
    """
    domain, sub = _domain_and_subdomain(captures, level)
    small = (
        captures.where(F.col("surtkey").isNotNull())
        .groupBy(domain.alias("base_domain"), sub.alias("subdomain"), "crawl_year")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("base_domain").isNotNull())
    )
    stats = small.groupBy("base_domain").agg(
        F.sum("n").alias("total_captures"),
        F.count_distinct("subdomain").alias("unique_subdomains"),
        F.count_distinct("crawl_year").alias("years_covered"),
        F.sum(F.when(F.col("subdomain") == "", F.col("n")).otherwise(0)).alias("bare_captures"),
    )
    top = (
        small.groupBy("base_domain", "subdomain")
        .agg(F.sum("n").alias("n"))
        .groupBy("base_domain")
        .agg(F.min(F.struct((-F.col("n")).alias("neg"), "subdomain")).alias("first"))
        .select(
            "base_domain",
            F.col("first.subdomain").alias("top_subdomain"),
            (-F.col("first.neg")).alias("top_subdomain_count"),
        )
    )
    return (
        stats.join(top, "base_domain", "left")
        .select(
            "base_domain",
            "total_captures",
            "unique_subdomains",
            "years_covered",
            "top_subdomain",
            "top_subdomain_count",
            "bare_captures",
            ratio_pct(F.col("bare_captures"), F.col("total_captures"), 1).alias("pct_bare"),
        )
        .orderBy(F.col("total_captures").desc(), "base_domain")
    )


def subdomain_label(df: DataFrame, level: str) -> Column:
    if level == "top" and "surthost_seg_2" in df.columns:
        return F.coalesce("surthost_seg_2", F.lit(BARE))
    return urls.label_if_empty(urls.stored_or(df, "sub_full", urls.full_subdomain()), BARE)


def subdomain_breakdown(
    captures: DataFrame,
    years=CRAWL_YEARS,
    limit: int | None = 20,
    level: str = "top",
    within: list[str] | None = None,
) -> DataFrame:
    """Captures per subdomain and year with a total, largest first."""
    within = within or []
    rows = captures.where(F.col("surtkey").isNotNull()).withColumn(
        "subdomain", subdomain_label(captures, level)
    )
    wide = roll.year_pivot(rows, [*within, "subdomain"], years)
    order = [F.col("total").desc(), F.col("subdomain")]
    if limit is None:
        return wide.orderBy(*within, *order)
    return roll.top_k(wide, limit, order, within)


def unique_subdomains(captures: DataFrame, level: str = "top", within=None) -> DataFrame:
    label = subdomain_label(captures, level)
    rows = captures.where(F.col("surtkey").isNotNull())
    return rows.groupBy(*(within or [])).agg(F.count_distinct(label).alias("n"))


def domain_ranking(captures: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    label = dom.registered_or_other(captures, domains)
    counts = captures.groupBy(label.alias("base_domain")).agg(F.count(F.lit(1)).alias("captures"))
    return roll.most_frequent_first(counts, "captures", "base_domain")


def top_subdomains(captures: DataFrame, domains=TARGET_DOMAINS, k: int = 10) -> DataFrame:
    """The k largest subdomains of each target domain."""
    sub = urls.label_if_empty(urls.stored_or(captures, "sub_full", urls.full_subdomain()), "(bare)")
    counts = (
        captures.where(F.col("surtkey").isNotNull())
        .groupBy(dom.registered_or_other(captures, domains).alias("base_domain"), sub.alias("subdomain"))
        .agg(F.count(F.lit(1)).alias("captures"))
        .where(F.col("base_domain") != "other")
    )
    order = [F.col("captures").desc(), F.col("subdomain")]
    return roll.top_k(counts, k, order, ["base_domain"]).orderBy("base_domain", *order)


def domain_year_table(captures: DataFrame, domains=TARGET_DOMAINS, years=CRAWL_YEARS) -> DataFrame:
    """Captures per domain and year, largest domain first."""
    rows = captures.withColumn("label", dom.registered_or_other(captures, domains))
    wide = roll.year_pivot(rows, ["label"], years, total="_total")
    return (
        wide.withColumnRenamed("label", "base_domain")
        .orderBy(F.col("_total").desc(), "base_domain")
        .drop("_total")
    )


def captures_per_month(captures: DataFrame) -> DataFrame:
    stamp = F.col("fetch_timestamp")
    return (
        captures.where(stamp.isNotNull() & (F.length(stamp) >= 6))
        .groupBy("crawl_year", month_of(stamp).alias("yyyymm"))
        .agg(F.count(F.lit(1)).alias("captures"))
        .orderBy("crawl_year", "yyyymm")
    )


def distinct_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return roll.distinct_per_column(df, columns)

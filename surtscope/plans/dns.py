"""DNS records among the captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtscope.config import TARGET_DOMAINS
from surtscope.functions.measures import occurrence_bucket, rint_digits
from surtscope.operators import domains as dom
from surtscope.operators import rollups as roll

DNS = "text/dns"


def dns_only(captures: DataFrame, domain: str | None = None) -> DataFrame:
    """DNS rows, of one domain if given; both tests reach the Parquet scan."""
    rows = captures.where(F.col("mime") == DNS)
    return rows if domain is None else dom.of_one_domain(rows, domain)


def dns_share(captures: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    label = dom.target(captures, domains).alias("domain")
    counts = (
        captures.select(label, "mime")
        .where(F.col("domain").isNotNull())
        .groupBy("domain")
        .agg(
            F.count_if(F.col("mime") == DNS).alias("dns_records"),
            F.count(F.lit(1)).alias("total_records"),
        )
    )
    pct = F.lit(100.0) * F.col("dns_records") / F.col("total_records")
    return counts.withColumn("dns_pct", rint_digits(pct, 4)).orderBy(
        F.col("dns_records").desc(), "domain"
    )


def dns_sample(captures: DataFrame, domain: str | None = None, limit: int = 20) -> DataFrame:
    """The earliest DNS records."""
    rows = dns_only(captures, domain)
    order = [F.col("fetch_timestamp"), F.col("url"), F.col("host"), F.col("length"), F.col("offset")]
    return (
        rows.orderBy(*[c.asc_nulls_last() for c in order])
        .limit(limit)
        .select("url", "host", "fetch_timestamp", "status", "length")
    )


def dns_totals(captures: DataFrame, domain: str | None = None) -> DataFrame:
    """Counted per (url, host) first, so the two distincts run on a small frame."""
    small = dns_only(captures, domain).groupBy("url", "host").agg(F.count(F.lit(1)).alias("n"))
    return small.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_dns_records"),
        F.count_distinct("url").alias("unique_dns_urls"),
        F.count_distinct("host").alias("unique_hosts"),
    )


def dns_top_hosts(captures: DataFrame, domain: str | None = None, limit: int = 30) -> DataFrame:
    counts = roll.count_by(dns_only(captures, domain), ["host"])
    return roll.top_k(counts, limit, [F.col("n").desc(), F.col("host").asc_nulls_last()])


def dns_repeats(captures: DataFrame, domain: str | None = None) -> DataFrame:
    """How many hosts were looked up once, a few times, or often."""
    per_host = roll.count_by(dns_only(captures, domain), ["host"])
    return (
        per_host.groupBy(occurrence_bucket(F.col("n")).alias("occurrences_per_host"))
        .agg(
            F.count(F.lit(1)).alias("host_count"),
            F.sum("n").alias("total_dns_records"),
            F.min("n").alias("_order"),
        )
        .orderBy("_order")
        .drop("_order")
    )

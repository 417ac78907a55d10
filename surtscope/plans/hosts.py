"""Host and path reports on raw URLs, and counts over the Parquet index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtscope.config import TARGET_DOMAINS
from surtscope.functions import urls
from surtscope.operators import domains as dom
from surtscope.operators import rollups as roll
from surtscope.operators.fences import computed_once


def index_counts(index: DataFrame, column: str) -> DataFrame:
    """Index rows per value of one host column, largest first."""
    counts = roll.count_by(index, [column], "url_count")
    return roll.most_frequent_first(counts, "url_count", column)


def index_with_status(index: DataFrame, status: int = 404) -> DataFrame:
    return index.where(F.col("fetch_status") == status).select("url_surtkey", "fetch_status")


def hosts_of(captures: DataFrame) -> DataFrame:
    """``host`` of URLs with an authority, port dropped; reads the url column only."""
    return computed_once(captures.select("url"), {"host": urls.authority_host("url")}).drop("url")


def host_paths_of(captures: DataFrame) -> DataFrame:
    """``host`` with its port and ``path``; reads the url column only."""
    parts = {"host": urls.host_and_port("url"), "path": urls.url_path("url")}
    return computed_once(captures.select("url"), parts).drop("url")


def _labelled(rows: DataFrame, domains) -> DataFrame:
    return rows.withColumn("base_domain", dom.host_domain("host", domains)).where(
        F.col("base_domain").isNotNull()
    )


def _counted(rows: DataFrame, keys: list[str], first: list[str]) -> DataFrame:
    counts = roll.count_by(rows, keys, "captures")
    rest = [k for k in keys if k not in first]
    return counts.orderBy(*first, F.col("captures").desc(), *rest)


def domain_hosts(captures: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    rows = _labelled(hosts_of(captures), domains)
    return _counted(rows, ["base_domain", "host"], ["base_domain"])


def host_first_paths(captures: DataFrame, domain: str) -> DataFrame:
    rows = host_paths_of(captures).where(dom.is_host_in("host", domain))
    rows = rows.withColumn("path1", urls.first_segment("path"))
    return _counted(rows, ["host", "path1"], [])


def domain_host_paths(captures: DataFrame, domains=TARGET_DOMAINS, segments: int = 1) -> DataFrame:
    """Captures per domain, host and first one or two path segments."""
    name = f"path{segments}"
    path: Column = urls.first_segment("path") if segments == 1 else urls.first_two_segments("path")
    rows = _labelled(host_paths_of(captures), domains).withColumn(name, path)
    return _counted(rows, ["base_domain", "host", name], ["base_domain", "host"])


def url_contains(captures: DataFrame, text: str) -> DataFrame:
    return captures.where(F.contains(F.lower("url"), F.lit(text.lower()))).agg(
        F.count(F.lit(1)).alias("n")
    )

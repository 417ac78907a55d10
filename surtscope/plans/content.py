"""Status, MIME type, size and content-digest reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtscope.config import TARGET_DOMAINS
from surtscope.functions import urls
from surtscope.functions.measures import (
    STATUS_CLASSES,
    WEIGHT,
    duplication_pct,
    ratio_pct,
    rint_digits,
    status_class,
    to_bigint,
)
from surtscope.operators import domains as dom
from surtscope.operators import quantiles as quant
from surtscope.operators import rollups as roll


def status_distribution(captures: DataFrame) -> DataFrame:
    counts = roll.count_by(captures, ["status"], "captures")
    return roll.most_frequent_first(roll.with_share(counts, "captures"), "captures", "status")


def status_classes_by_domain(captures: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    """Percentage of each status class per domain."""
    rows = captures.select(
        dom.registered_or_other(captures, domains).alias("base_domain"),
        status_class().alias("cls"),
    )
    wide = rows.groupBy("base_domain").agg(
        *[F.count_if(F.col("cls") == c).alias(c) for c in STATUS_CLASSES]
    )
    return roll.row_percentages(wide, STATUS_CLASSES, 1).orderBy(F.col("2xx").desc(), "base_domain")


def mime_distribution(captures: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent MIME types and their share of all captures."""
    mime = F.coalesce("mime", F.lit("(null)")).alias("mime")
    counts = captures.groupBy(mime).agg(F.count(F.lit(1)).alias("captures"))
    shares = roll.with_share(counts, "captures")
    return roll.top_k(shares, limit, [F.col("captures").desc(), F.col("mime")])


def mime_mismatch(captures: DataFrame) -> DataFrame:
    both = captures.where(F.col("mime").isNotNull() & F.col("mime_detected").isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("mime") != F.col("mime_detected")).alias("mismatched"),
    ).withColumn("mismatch_pct", ratio_pct(F.col("mismatched"), F.col("total"), 2))


def size_histogram(captures: DataFrame) -> DataFrame:
    """Captures of each record size by year and domain: one scan, and all that size
    statistics need. Histograms of parts of a table add up to that of the whole."""
    reg_domain = urls.stored_or(captures, "reg_domain", urls.registered_domain())
    rows = captures.where(F.col("length") > 0).withColumn("reg_domain", reg_domain)
    return roll.compact(rows, ["crawl_year", "base_domain", "reg_domain", "length"])


def size_statistics(captures: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    """Record sizes per domain, of captures or of a stored :func:`size_histogram`, in
    narrow passes that shuffle only counts."""
    kept = [c for c in ("length", WEIGHT) if c in captures.columns]
    rows = captures.where(F.col("length") > 0).select(
        dom.registered_or_other(captures, domains).alias("base_domain"), *kept
    )
    keys = ["base_domain"]
    sizes = quant.blocked(rows, keys, "length")
    basic = sizes.groupBy(*keys).agg(
        F.sum("_rows").alias("n"),
        F.min("_v").alias("min_bytes"),
        F.max("_v").alias("max_bytes"),
        F.sum(F.col("_v") * F.col("_rows")).alias("total_bytes"),
    )
    exact = quant.quantiles(sizes, keys, {"median": 0.5, "p95": 0.95})
    return (
        basic.join(exact, "base_domain")
        .select(
            "base_domain",
            "n",
            "min_bytes",
            to_bigint(F.col("median")).alias("median_bytes"),
            to_bigint(F.col("p95")).alias("p95_bytes"),
            "max_bytes",
            to_bigint(F.col("total_bytes") / F.col("n")).alias("avg_bytes"),
            "total_bytes",
            rint_digits(F.col("total_bytes") / F.lit(1e9), 2).alias("total_gb"),
        )
        .orderBy(F.col("total_bytes").desc(), "base_domain")
    )


def _duplication(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_captures"),
        F.count_distinct("digest").alias("unique_digests"),
    ).withColumn(
        "duplication_pct", duplication_pct(F.col("unique_digests"), F.col("total_captures"), 1)
    )


def digest_duplication(captures: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    rows = captures.where(F.col("digest").isNotNull()).select(
        dom.registered_or_other(captures, domains).alias("base_domain"), "digest"
    )
    return _duplication(rows, ["base_domain"]).orderBy(F.col("duplication_pct").desc(), "base_domain")


def digest_duplication_overall(captures: DataFrame) -> DataFrame:
    return _duplication(captures.where(F.col("digest").isNotNull()).select("digest"), [])

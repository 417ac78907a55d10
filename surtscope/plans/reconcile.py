"""The captures table against the Parquet index of the same crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surtscope.config import CRAWL_YEARS, TARGET_DOMAINS
from surtscope.functions.measures import composite, rint_digits
from surtscope.operators import domains as dom
from surtscope.operators import rollups as roll
from surtscope.operators.reconcile import count_diff, largest_gap_first


def _rows(name: str):
    return F.count(F.lit(1)).alias(name)


def total_diff(captures: DataFrame, index: DataFrame) -> DataFrame:
    indexed = index.agg(_rows("n")).scalar()
    return (
        captures.agg(_rows("cdxj_rows"))
        .withColumn("parquet_rows", indexed)
        .withColumn("diff", F.col("parquet_rows") - F.col("cdxj_rows"))
    )


def year_diff(captures: DataFrame, index: DataFrame, missing_as_zero: bool = False) -> DataFrame:
    left = captures.groupBy("crawl_year").agg(_rows("cdxj_rows"))
    right = index.groupBy("crawl_year").agg(_rows("parquet_rows"))
    diffs = count_diff(left, right, ["crawl_year"], "cdxj_rows", "parquet_rows", missing_as_zero)
    return diffs.select("crawl_year", "parquet_rows", "cdxj_rows", "diff").orderBy("crawl_year")


def year_domain_diff(captures: DataFrame, index: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    """Year x domain counts of both sides; an absent side stays NULL, the diff does not."""
    keys = ["crawl_year", "domain"]
    label = dom.registered_or_other(captures, domains).alias("domain")
    left = captures.groupBy("crawl_year", label).agg(_rows("cdxj_rows"))
    reg = F.col("url_host_registered_domain")
    right = (
        index.where(reg.isin(*domains)).groupBy("crawl_year", reg.alias("domain")).agg(_rows("parquet_rows"))
    )
    zero = F.lit(0)
    return (
        left.join(right, keys, "full_outer")
        .withColumn("diff", F.coalesce("parquet_rows", zero) - F.coalesce("cdxj_rows", zero))
        .select(*keys, "parquet_rows", "cdxj_rows", "diff")
        .orderBy(*keys)
    )


def year_summary(diffs: DataFrame) -> DataFrame:
    """Per-year sums of :func:`year_domain_diff` and the relative difference."""
    sums = diffs.groupBy("crawl_year").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("parquet_rows", "cdxj_rows", "diff")]
    )
    pct = F.lit(100.0) * F.col("diff") / F.nullif(F.col("cdxj_rows"), F.lit(0))
    return sums.withColumn("pct_diff", rint_digits(pct, 2)).orderBy("crawl_year")


def _labelled(df: DataFrame, key: str, domains) -> DataFrame:
    return df.withColumn("domain_label", dom.target(df, domains, key))


def _domain_counts(captures, index, domains, extra: list[str]):
    """Counts by SURT label; captures keep ``other``, the index keeps targets only."""
    label = F.col("domain_label")
    left = _labelled(captures, "surtkey", domains).groupBy(
        F.coalesce(label, F.lit("other")).alias("label"), *extra
    ).agg(_rows("cdxj_rows")).withColumnRenamed("label", "base_domain")
    right = (
        _labelled(index, "url_surtkey", domains)
        .where(label.isNotNull())
        .groupBy(label.alias("label"), *extra)
        .agg(_rows("parquet_rows"))
        .withColumnRenamed("label", "base_domain")
    )
    return left, right


def domain_diff(captures: DataFrame, index: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    left, right = _domain_counts(captures, index, domains, [])
    diffs = count_diff(left, right, ["base_domain"], "cdxj_rows", "parquet_rows")
    return largest_gap_first(diffs, "base_domain")


def domain_year_gaps(captures: DataFrame, index: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    """Only the domain x year cells in which the sources differ."""
    keys = ["base_domain", "crawl_year"]
    left, right = _domain_counts(captures, index, domains, ["crawl_year"])
    diffs = count_diff(left, right, keys, "cdxj_rows", "parquet_rows").where(F.col("diff") != 0)
    return largest_gap_first(diffs, *keys)


def subset_breakdown(index: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    rows = dom.only_targets(index, domains, "url_surtkey")
    return roll.most_frequent_first(rows.groupBy("subset").agg(_rows("rows")), "rows", "subset")


def duplicate_rows(captures: DataFrame, index: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    """Rows that repeat a (url, digest) pair, per source."""
    def pairs(df: DataFrame, source: str, digest: str) -> DataFrame:
        key = composite(F.col("url"), F.coalesce(digest, F.lit("")))
        return df.select(F.lit(source).alias("source"), key.alias("pair"))

    both = pairs(captures, "CDXJ", "digest").unionByName(
        pairs(dom.only_targets(index, domains, "url_surtkey"), "parquet", "content_digest")
    )
    return (
        both.groupBy("source")
        .agg(_rows("total"), F.count_distinct("pair").alias("_distinct"))
        .select("source", "total", (F.col("total") - F.col("_distinct")).alias("duplicate_rows"))
    )


def outside_targets(index: DataFrame, domains=TARGET_DOMAINS, limit: int = 20) -> DataFrame:
    """The most frequent hosts of the index that belong to no target domain."""
    keys = ["url_host_name", "url_host_registered_domain"]
    counts = dom.outside_targets(index, domains, "url_surtkey").groupBy(*keys).agg(_rows("rows"))
    return roll.top_k(
        counts, limit, [F.col("rows").desc(), *[F.col(k).asc_nulls_last() for k in keys]]
    )


SOURCES = ("parquet", "CDXJ")


def domain_year_long(
    spark: SparkSession,
    captures: DataFrame,
    index: DataFrame,
    domains=TARGET_DOMAINS,
    years=CRAWL_YEARS,
) -> DataFrame:
    """``domain, source, year, n`` over the full grid, with ``ALL`` rows.

    The grid comes from the domain dimension and the two literal lists, so it
    is complete even for cells without captures.
    """
    def counted(df: DataFrame, key: str, source: str) -> DataFrame:
        return (
            _labelled(df, key, domains)
            .where(F.col("domain_label").isNotNull())
            .groupBy(F.col("domain_label").alias("domain"), F.col("crawl_year").alias("year"))
            .agg(_rows("n"))
            .withColumn("source", F.lit(source))
        )

    counts = counted(captures, "surtkey", "CDXJ").unionByName(counted(index, "url_surtkey", "parquet"))
    grid = (
        dom.domain_dimension(spark, domains)
        .select("domain", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
        .select("domain", "year", F.explode(F.array(*[F.lit(s) for s in SOURCES])).alias("source"))
    )
    filled = grid.join(counts, ["domain", "year", "source"], "left").na.fill(0, subset=["n"])
    return roll.with_year_totals(filled, ["domain", "source"], "year", "n")


def domain_year_matrix(
    spark: SparkSession,
    captures: DataFrame,
    index: DataFrame,
    domains=TARGET_DOMAINS,
    years=CRAWL_YEARS,
    drop_suffix: str = ".gov",
) -> DataFrame:
    """One row per domain folder, one column per year and source, plus ``ALL``."""
    long = domain_year_long(spark, captures, index, domains, years)
    columns = [f"{y} {s}" for s in SOURCES for y in [*years, "ALL"]]
    wide = roll.pivot_values(
        long.withColumn("cell", F.concat_ws(" ", "year", "source")), ["domain"], "cell", columns, "n"
    )
    folders = dom.domain_dimension(spark, domains, drop_suffix).select("domain", "folder")
    return wide.join(folders, "domain").select("folder", *columns).orderBy("folder")


def split_report(
    spark: SparkSession,
    captures: DataFrame,
    index: DataFrame,
    domains=TARGET_DOMAINS,
    drop_suffix: str = ".gov",
) -> DataFrame:
    """Rows each per-domain table gets from either source."""
    left, right = _domain_counts(captures, index, domains, [])
    folders = dom.domain_dimension(spark, domains, drop_suffix)
    keyed = folders.select(F.col("domain").alias("base_domain"), "folder")
    both = keyed.join(left, "base_domain", "left").join(right, "base_domain", "left")
    both = both.na.fill(0, subset=["cdxj_rows", "parquet_rows"])
    return both.select(
        "folder",
        "cdxj_rows",
        "parquet_rows",
        (F.col("parquet_rows") - F.col("cdxj_rows")).alias("diff"),
    ).orderBy("folder")

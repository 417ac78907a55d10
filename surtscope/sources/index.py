"""Pre-built Parquet capture indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surtscope.config import CRAWL_YEARS, YEAR_IN_PATH, resolve_years


def read_year(spark: SparkSession, folder: str, year: str) -> DataFrame:
    """One crawl year's Parquet folder with its year as a literal column."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(folder).withColumn(
        "crawl_year", F.lit(str(year))
    )


def read_years(
    spark: SparkSession, folders: dict[str, str], years="all", allowed=CRAWL_YEARS
) -> DataFrame:
    """Several years united by column name, absent columns NULL. ``"all"`` means the
    years that have a folder; a year asked for by name must have one."""
    wanted = resolve_years(years, allowed)
    if years == "all":
        wanted = [y for y in wanted if y in folders]
    absent = [y for y in wanted if y not in folders]
    if absent or not wanted:
        raise ValueError(f"no folder for crawl year(s) {absent or list(allowed)}")
    frames = [read_year(spark, folders[y], y) for y in wanted]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_partitioned(spark: SparkSession, root: str, key: str = "crawl") -> DataFrame:
    """A ``crawl=<archive>-YYYY`` layout; a filter on the year prunes folders."""
    df = spark.read.option("basePath", root).parquet(root)
    return df.withColumn("crawl_year", F.regexp_extract(F.col(key).cast("string"), r"(\d{4})\z", 1))


def read_recursive(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """Every Parquet file below a folder, whatever the folders are called."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).parquet(root)
    )


def with_year_from_file(df: DataFrame, pattern: str = YEAR_IN_PATH) -> DataFrame:
    """Crawl year cut from each row's file path."""
    return df.withColumn(
        "crawl_year", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    )


def list_files(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """``key, size`` of the files below a folder; file contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select(F.col("path").alias("key"), F.col("length").alias("size"))
    )


def file_count(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    return list_files(spark, root, glob).agg(F.count(F.lit(1)).alias("files"))

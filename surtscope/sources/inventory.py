"""File inventories: manifests, suffix filters and pending-file reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``key, size`` from a gzip text manifest; such a list carries no sizes."""
    key = F.btrim(F.col("value"), F.lit(" \t\r\n\f\v"))
    return (
        spark.read.text(path)
        .select(key.alias("key"), F.lit(None).cast("bigint").alias("size"))
        .where(F.col("key") != "")
    )


def with_suffix(inventory: DataFrame, suffix: str) -> DataFrame:
    return inventory.where(F.col("key").endswith(suffix))


def file_name(key: Column | str = "key") -> Column:
    return F.substring_index(F.col(key) if isinstance(key, str) else key, "/", -1)


def _with_hits(inventory: DataFrame, local: DataFrame) -> DataFrame:
    """Inventory entries with ``_hit``, true where a local file has that name and, if the
    inventory knows it, that size.

    A local file is found under its name and size, and under its name alone; each of
    these keys stands once, so an entry meets one row at most.
    """
    keys = local.select("name", F.explode(F.array("size", F.lit(None).cast("bigint"))).alias("size")).distinct()
    want, have = inventory.withColumn("name", file_name()).alias("want"), keys.withColumn("_hit", F.lit(True)).alias("have")
    same = (F.col("want.name") == F.col("have.name")) & F.col("want.size").eqNullSafe(F.col("have.size"))
    hit = F.coalesce("_hit", F.lit(False)).alias("_hit")
    return want.join(have, same, "left").select(*[F.col(f"want.`{c}`") for c in inventory.columns], hit)


def pending(inventory: DataFrame, local: DataFrame) -> DataFrame:
    """Inventory entries with no local file of that name (and size, if known)."""
    return _with_hits(inventory, local).where(~F.col("_hit")).drop("_hit")


def pending_summary(inventory: DataFrame, local: DataFrame) -> DataFrame:
    """Files found, pending and skipped, and the bytes still to fetch, from one join."""
    todo = ~F.col("_hit")
    return _with_hits(inventory, local).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(todo).alias("pending"),
        F.count_if(F.col("_hit")).alias("skipped"),
        F.coalesce(F.sum(F.when(todo, F.col("size"))), F.lit(0)).alias("pending_bytes"),
    )

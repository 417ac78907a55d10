"""Exact interpolated quantiles of integer measures, safe for huge groups.

``percentile`` keeps one map of value to count per group in a single task; a
domain that holds a third of all captures would need all its distinct sizes
there. Here values fall into blocks of ``2**16`` neighbours. A first pass counts
rows per block, the block that holds each wanted rank is found on that small
histogram, and a second pass counts single values in those blocks only. Nothing
but counts is shuffled, and no task holds more than one block of one group.

A stored histogram (values with a ``capture_count``) gives the same quantiles as the
rows it was made from; histograms of parts merge by adding their counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surtscope.functions.measures import WEIGHT

_BLOCK_BITS = 16


def blocked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, _v, _block, _rows`` of the rows that have a value, ``_rows`` being how many a
    row stands for; keys must not be NULL."""
    # never NULL after the filter; saying so keeps Spark from adding NULL tests
    # to some uses of this frame, which would stop their reuse
    number = F.coalesce(F.col(value).cast("long"), F.lit(0).cast("long"))
    weight = F.coalesce(F.col(WEIGHT), F.lit(0)) if WEIGHT in df.columns else F.lit(1)
    rows = df.where(F.col(value).isNotNull()).select(*keys, number.alias("_v"), weight.cast("long").alias("_rows"))
    return rows.withColumn("_block", F.shiftright(F.col("_v"), _BLOCK_BITS))


def _wanted_ranks(rows: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """Per block the wanted ranks that lie in it, counted from its first row."""
    blocks = rows.groupBy(*keys, "_block").agg(F.sum("_rows").alias("_n"))
    by_block = Window.partitionBy(*keys).orderBy("_block")
    whole = Window.partitionBy(*keys)
    placed = blocks.select(
        *keys,
        "_block",
        "_n",
        F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_n").over(whole).alias("_all"),
    )
    targets = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(side).alias("side"),
                (F.lit(float(p)) * (F.col("_all") - 1)).alias("pos"),
            )
            for name, p in wanted.items()
            for side in ("low", "high")
        ]
    )
    before = F.col("_upto") - F.col("_n")
    ranked = placed.select(*keys, "_block", "_upto", before.alias("_before"), F.inline(targets))
    rank = F.when(F.col("side") == "low", F.floor("pos")).otherwise(F.ceil("pos"))
    return (
        ranked.withColumn("rank", rank)
        .where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_upto")))
        .groupBy(*keys, "_block")
        .agg(
            F.collect_list(
                F.struct("name", "side", "pos", (F.col("rank") - F.col("_before")).alias("rank"))
            ).alias("_ranks")
        )
    )


def quantiles(
    rows: DataFrame,
    keys: list[str],
    wanted: dict[str, float],
) -> DataFrame:
    """``keys`` plus one double column per entry of ``wanted`` (name -> fraction).

    ``rows`` comes from :func:`blocked`. Interpolates between the two
    neighbouring ranks, as ``percentile_cont`` does. The wanted blocks are few rows,
    which AQE broadcasts once it has seen their size.
    """
    ranks = _wanted_ranks(rows, keys, wanted)
    values = rows.join(ranks.select(*keys, "_block"), [*keys, "_block"], "left_semi")
    counts = values.groupBy(*keys, "_block", "_v").agg(F.sum("_rows").alias("_n"))
    in_block = Window.partitionBy(*keys, "_block").orderBy("_v")
    hit = (
        counts.join(ranks, [*keys, "_block"])
        .withColumn("_last", F.sum("_n").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*keys, "_v", "_n", "_last", F.inline("_ranks"))
        .where((F.col("rank") >= F.col("_last") - F.col("_n")) & (F.col("rank") < F.col("_last")))
    )
    aggs = []
    for name in wanted:
        mine = F.col("name") == name
        low = F.max(F.when(mine & (F.col("side") == "low"), F.col("_v"))).cast("double")
        high = F.max(F.when(mine & (F.col("side") == "high"), F.col("_v"))).cast("double")
        pos = F.max(F.when(mine, F.col("pos")))
        aggs.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return hit.groupBy(*keys).agg(*aggs)

"""Keeping costly expressions from being evaluated more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters read instead of recomputing.

    Catalyst moves a filter below the projection that defines its columns and
    copies their expressions into it, so parsing a blob and then filtering on
    the result would parse twice or more. A one-element generator stops that,
    while filters on the other columns still move below it.
    """
    return df.select(
        "*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    )

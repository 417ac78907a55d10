"""Stored counts that follow their captures table by signed deltas.

A report base (``structure.report_base``) or histogram (``content.size_histogram``)
holds one row with a count for each combination of what its reports group by. It is a
table of loads like the captures (see ``loads``), and its list notes which loads and years of the captures it
counts. A refresh compares that note with the captures' list: rows that came are added,
rows that were replaced are subtracted, and only the crawl years in which either
happened are written anew, in one step. Of the captures only the folders of those
loads and years are read, of the base only those years.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surtscope.functions.measures import WEIGHT
from surtscope.plans import structure
from surtscope.tables import loads, store

#: Makes counted rows of captures; they carry ``crawl_year`` and ``base_domain``.
Summary = Callable[[DataFrame], DataFrame]


def structure_base(captures: DataFrame) -> DataFrame:
    return structure.report_base(captures, ["base_domain"])


def _counted_years(table: loads.Live | None) -> dict[str, list[str | None]]:
    """Name of each load to its years that count."""
    return {x.name: x.live_years() for x in (table.loads if table else ()) if x.live_years()}


def _without(years: list[str | None], left_out) -> list[str | None]:
    return [y for y in years if y not in left_out]


def _less(one: dict[str, list[str | None]], other: dict[str, list[str | None]]) -> dict[str, list[str | None]]:
    """Years of each load that only ``one`` counts."""
    rest = {n: _without(years, other.get(n, [])) for n, years in one.items()}
    return {n: years for n, years in rest.items() if years}


def _part(
    spark: SparkSession, path: str, years: dict[str, list[str | None]], sign: int, summary: Summary
) -> DataFrame | None:
    """Counted rows of some loads and years of the captures, with signed counts."""
    listed = []
    for name, wanted in years.items():
        if not wanted:
            continue
        stored = loads.years_of(spark, path, name)
        listed.append(loads.Load(name, "", stored, tuple(y for y in stored if y not in wanted)))
    if not listed:
        return None
    rows = loads.read(spark, path, store.table_schema(), loads.Live(loads=tuple(listed)))
    return summary(rows).withColumn(WEIGHT, F.lit(sign) * F.col(WEIGHT))


def read(spark: SparkSession, path: str, summary: Summary = structure_base) -> DataFrame:
    """The stored counts, with the columns that the summary makes."""
    return loads.read(spark, path, summary(spark.createDataFrame([], store.table_schema())).schema)


def refresh(
    spark: SparkSession, captures_path: str, path: str, summary: Summary = structure_base
) -> list[str | None]:
    """Bring the counts at ``path`` up to the captures; returns the years written.

    A refresh that dies has changed nothing, and one without news writes nothing. Years
    whose replaced rows were removed from storage meanwhile are counted anew.
    """
    now = _counted_years(loads.current(spark, captures_path))
    table = loads.live(spark, path)
    before = json.loads(table.note) if table and table.note else {}
    came, gone = _less(now, before), _less(before, now)
    touched = sorted({y for part in (came, gone) for years in part.values() for y in years}, key=lambda y: (y is None, y or ""))
    if not touched:
        return []
    stored = {n: loads.years_of(spark, captures_path, n) for n in gone}
    lost = {y for n, years in gone.items() for y in years if y not in stored[n]}
    recount = {n: [y for y in years if y in lost] for n, years in now.items()}
    came = {n: _without(came.get(n, []), lost) + recount[n] for n in now}
    gone = {n: _without(years, lost) for n, years in gone.items()}

    columns = read(spark, path, summary).columns
    parts = [_part(spark, captures_path, came, 1, summary), _part(spark, captures_path, gone, -1, summary)]
    if before:
        old = read(spark, path, summary)
        # years counted anew take nothing over
        parts.append(old.where(loads.any_year(_without(touched, lost))))
    signed = reduce(DataFrame.unionByName, [p.select(*columns) for p in parts if p is not None])
    keys = [c for c in columns if c != WEIGHT]
    rows = signed.groupBy(*keys).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)
    note = json.dumps(now)
    metrics = {"rows": F.count(F.lit(1))}
    store.add_rows(rows.select(*columns), path, [], "refresh", metrics, touched, note=note)
    return touched

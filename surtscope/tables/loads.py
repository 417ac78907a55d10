"""Tables made of whole loads.

Every job writes its rows into a ``load=<name>`` folder of its own, laid out by crawl
year and domain. Only then does it add the load to the list of those that count, a
short file ``_live/<version>.json`` that appears in one step; the same step can hide
the years that the load replaces in earlier ones. Readers open the folders of
listed loads, and a partition filter skips replaced years, so they see a load whole or
not at all, and a year is swapped whole. A job that dies before that step has changed nothing; run
again under the same name it overwrites its own folder.

The list also holds the table's schema where that may grow (see ``index_table``), or a
note of what a derived table was made from (see ``report_table``), and beside the rows each load keeps the names of the files it read, so that another run
can tell what is loaded already. Rows of a plain ``crawl_year=…`` layout at the same
path count as a first load.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surtscope.tables import files

LOAD, YEAR = "load", "crawl_year"
PLAIN = ""
_NULL_YEAR = "__HIVE_DEFAULT_PARTITION__"
#: Versions of the list that stay behind the newest.
_KEPT_VERSIONS = 20


@dataclass(frozen=True)
class Load:
    """Rows written by one job. ``hidden`` are the years that later loads replaced."""

    name: str
    source: str
    years: tuple[str | None, ...]
    hidden: tuple[str | None, ...] = ()

    def live_years(self) -> list[str | None]:
        return [y for y in self.years if y not in self.hidden]


@dataclass(frozen=True)
class Live:
    """One version of the list of loads."""

    version: int = 0
    loads: tuple[Load, ...] = ()
    schema: str | None = None
    note: str | None = None

    def names(self) -> set[str]:
        return {load.name for load in self.loads}

    def not_from(self, source: str) -> Live:
        return replace(self, loads=tuple(load for load in self.loads if load.source != source))


def _version_path(path: str, version: int) -> str:
    return f"{path}/_live/{version:08d}.json"


def live(spark: SparkSession, path: str) -> Live | None:
    """The newest list; None for a folder that never had one."""
    found = [int(n.removesuffix(".json")) for n in files.names(spark, f"{path}/_live") if n.endswith(".json") and n[0] != "."]
    if not found:
        return None
    content = json.loads(files.read_text(spark, _version_path(path, max(found))))
    loads = tuple(Load(x["name"], x["source"], tuple(x["years"]), tuple(x["hidden"])) for x in content["loads"])
    return Live(max(found), loads, content["schema"], content["note"])


def years_of(spark: SparkSession, path: str, name: str) -> tuple[str | None, ...]:
    """Years of a load whose folders are still there."""
    return _years_below(spark, path if name == PLAIN else folder(path, name))


def _years_below(spark: SparkSession, folder: str) -> tuple[str | None, ...]:
    found = [n.removeprefix(f"{YEAR}=") for n in files.names(spark, folder) if n.startswith(f"{YEAR}=")]
    return tuple(None if y == _NULL_YEAR else y for y in sorted(found))


def current(spark: SparkSession, path: str) -> Live:
    """The newest list, or one that holds the plain rows found at ``path``."""
    found = live(spark, path)
    if found is not None:
        return found
    plain = _years_below(spark, path)
    return Live(loads=(Load(PLAIN, PLAIN, plain),) if plain else ())


def folder(path: str, name: str) -> str:
    return f"{path}/{LOAD}={name}"


def file_list_folder(path: str, name: str) -> str:
    return f"{path}/_files/{LOAD}={name}"


def write_file_list(names: DataFrame, path: str, name: str) -> None:
    """Keep ``file, crawl_year`` of what a load has read."""
    names.distinct().write.mode("overwrite").partitionBy(YEAR).parquet(file_list_folder(path, name))


def _written(spark: SparkSession, path: str, table: Live) -> bool:
    """Write a list; False if another writer has that version."""
    content = {"loads": [asdict(load) for load in table.loads], "schema": table.schema, "note": table.note}
    files.make_folder(spark, f"{path}/_live")
    return files.create_once(spark, _version_path(path, table.version), json.dumps(content, indent=1))


def begin(spark: SparkSession, path: str) -> None:
    """See that the table has a list before the first folder of a load is written, so that
    no reader takes such a folder for rows that count."""
    if live(spark, path) is None:
        _written(spark, path, replace(current(spark, path), version=1))


def publish(spark: SparkSession, path: str, name: str, source: str, replaces=(), schema: T.StructType | None = None, note: str | None = None) -> Live:
    """Make a written load count; ``replaces`` are the years it stands for alone, ``note``
    is kept with the list.

    Another job may publish at the same moment: whoever comes second takes the new
    list as its base and tries again. A name that is listed stays as it is.
    """
    years = _years_below(spark, folder(path, name))
    while True:
        base = current(spark, path)
        if name in base.names():
            return base
        earlier = tuple(
            replace(load, hidden=tuple(y for y in load.years if y in load.hidden or y in replaces)) for load in base.loads
        )
        text = schema.json() if schema else base.schema
        new = Live(base.version + 1, (*earlier, Load(name, source, years)), text, note or base.note)
        if _written(spark, path, new):
            files.remove(spark, _version_path(path, new.version - _KEPT_VERSIONS))
            return new


def any_year(years: list[str | None]) -> Column:
    named = [y for y in years if y is not None]
    condition = F.col(YEAR).isin(*named) if named else F.lit(False)
    return condition | F.col(YEAR).isNull() if None in years else condition


def _with_rows(table: Live) -> list[Load]:
    return [load for load in table.loads if load.name != PLAIN and load.live_years()]


def _plain_years(table: Live) -> list[str | None]:
    return [y for load in table.loads if load.name == PLAIN for y in load.live_years()]


def read(spark: SparkSession, path: str, schema: T.StructType, table: Live | None = None) -> DataFrame:
    """Rows that count, with the columns of ``schema`` in their order; ``table`` may be an
    older list or a part of one."""
    table = table or current(spark, path)
    columns = [F.col(f"`{c}`") for c in schema.fieldNames()]
    full = T.StructType([*schema.fields, T.StructField(LOAD, T.StringType())])
    frames = []
    listed = _with_rows(table)
    if listed:
        folders = [folder(path, load.name) for load in listed]
        rows = spark.read.schema(full).option("basePath", path).parquet(*folders)
        for load in listed:
            if load.hidden:
                rows = rows.where((F.col(LOAD) != load.name) | any_year(load.live_years()))
        frames.append(rows.select(*columns))
    plain = _plain_years(table)
    if plain:
        folders = [f"{path}/{YEAR}={_NULL_YEAR if y is None else y}" for y in plain]
        frames.append(spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*columns))
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, frames)


def known_files(spark: SparkSession, path: str, table: Live) -> DataFrame | None:
    """``file`` of every file that the listed loads have read; None if there is none."""
    listed = {n.removeprefix(f"{LOAD}=") for n in files.names(spark, f"{path}/_files")}
    # a load without rows still has read its files
    whole = [load.name for load in table.loads if load.name in listed and not load.hidden]
    cut = [load for load in table.loads if load.name in listed and load.hidden]
    if not whole and not cut:
        return None
    parts = [F.col(LOAD).isin(*whole)] if whole else []
    parts += [(F.col(LOAD) == load.name) & ~F.coalesce(any_year(list(load.hidden)), F.lit(False)) for load in cut]
    rows = spark.read.schema(f"file string, {YEAR} string, {LOAD} string").parquet(f"{path}/_files")
    return rows.where(reduce(lambda a, b: a | b, parts)).select("file").distinct()


def view_sql(spark: SparkSession, path: str, columns: list[str]) -> str:
    """A query over the rows that count now, for a view."""
    table = current(spark, path)

    def quoted(years) -> str:
        named = ", ".join(f"'{y}'" for y in years if y is not None)
        parts = [f"{YEAR} IN ({named})"] if named else []
        return " OR ".join(parts + ([f"{YEAR} IS NULL"] if None in years else []))

    def selected(**literal) -> str:
        return ", ".join(f"{literal[c]} AS `{c}`" if c in literal else f"`{c}`" for c in columns)

    typed, listed, plain = selected(**{YEAR: f"CAST({YEAR} AS STRING)"}), _with_rows(table), _plain_years(table)
    queries = []
    if listed and PLAIN not in table.names():
        cuts = [f"{LOAD} = '{x.name}'" + (f" AND ({quoted(x.live_years())})" if x.hidden else "") for x in listed]
        queries.append(f"SELECT {typed} FROM parquet.`{path}` WHERE {' OR '.join(f'({c})' for c in cuts)}")
    elif listed:
        queries += [f"SELECT {typed} FROM parquet.`{folder(path, x.name)}` WHERE {quoted(x.live_years())}" for x in listed]
    for year in plain:
        literal = "CAST(NULL AS STRING)" if year is None else f"'{year}'"
        place = f"{path}/{YEAR}={_NULL_YEAR if year is None else year}"
        queries.append(f"SELECT {selected(**{YEAR: literal})} FROM parquet.`{place}`")
    if not queries:
        raise ValueError(f"{path} holds no rows")
    return " UNION ALL ".join(queries)


def hidden_parts(table: Live) -> list[tuple[str, str | None]]:
    """(load, year) of everything that later loads replaced."""
    return [(load.name, y) for load in table.loads for y in load.hidden]


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the folders of replaced years; returns how many. Readers that still work
    with an older list must be done."""
    removed = 0
    for name, year in hidden_parts(current(spark, path)):
        place = f"{path if name == PLAIN else folder(path, name)}/{YEAR}={_NULL_YEAR if year is None else year}"
        if files.exists(spark, place):
            files.remove(spark, place)
            removed += 1
    return removed

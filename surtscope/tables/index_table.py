"""A labelled table of Parquet capture indexes, whose columns may grow.

Year folders of index files are appended as loads (see ``loads``). The domain label of
a row is computed once, when it is loaded, and stored as a partition, so comparisons of
sources skip the folders of other domains instead of testing every key again.

The files of different crawls differ: columns are matched by name whatever their order
and case, a column that a crawl lacks is NULL, a new one is added, and a number column
that comes wider than before widens the table's; earlier files stay as they are and
are read with the wider type. The table's schema is kept in its list of loads, so a
load and the columns it brings appear in one step.
"""

from __future__ import annotations

import fnmatch
import json
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surtscope.config import CRAWL_YEARS, TARGET_DOMAINS, resolve_years
from surtscope.operators import domains as dom
from surtscope.tables import files, loads, store

KEY = "url_surtkey"
OTHER = "other"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SMALL = _WHOLE[:3]


class TypeConflict(TypeError):
    """A column comes with a type that the table's files cannot be read with."""


def wider(name: str, table: T.DataType, new: T.DataType) -> T.DataType:
    """The type that holds both; files with the table's type must be readable with it."""
    if table == new or isinstance(table, T.StringType):
        return table
    if isinstance(table, _WHOLE) and isinstance(new, _WHOLE):
        return max(table, new, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(table, T.DoubleType) and isinstance(new, (*_SMALL, T.FloatType)):
        return table
    if isinstance(new, T.DoubleType) and isinstance(table, (*_SMALL, T.FloatType)):
        return new
    if isinstance(table, T.TimestampNTZType) and isinstance(new, T.DateType):
        return table
    if isinstance(table, T.DateType) and isinstance(new, T.TimestampNTZType):
        return new
    raise TypeConflict(f"column {name}: {new.simpleString()} does not fit {table.simpleString()}")


def merged(table: T.StructType, new: T.StructType) -> T.StructType:
    """The table's columns in their order, widened where needed, then the new ones."""
    fields = {f.name.lower(): f for f in table.fields}
    for field in new.fields:
        name = field.name.lower()
        if name in store.PARTITIONS:
            continue
        known = fields.get(name)
        kind = wider(field.name, known.dataType, field.dataType) if known else field.dataType
        fields[name] = T.StructField(known.name if known else field.name, kind)
    return T.StructType(list(fields.values()))


def _fitted(df: DataFrame, schema: T.StructType) -> list[Column]:
    have = {c.lower(): c for c in df.columns}
    return [
        (F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]


def label(domains=TARGET_DOMAINS, key: str = KEY) -> Column:
    """Target domain of a key or ``other``; NULL where there is no key."""
    return F.when(F.col(key).isNotNull(), F.coalesce(dom.surt_domain(key, domains), F.lit(OTHER)))


def table_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """Columns of the table without its partitions; None if there is no table yet."""
    table = loads.live(spark, path)
    return T.StructType.fromJson(json.loads(table.schema)) if table and table.schema else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole table: its columns, then ``crawl_year`` and ``base_domain``."""
    table = loads.live(spark, path)
    if table is None or table.schema is None:
        raise FileNotFoundError(f"no index table at {path}")
    columns = T.StructType.fromJson(json.loads(table.schema))
    partitions = [T.StructField(c, T.StringType()) for c in store.PARTITIONS]
    return loads.read(spark, path, T.StructType([*columns.fields, *partitions]), table)


def load_years(
    spark: SparkSession,
    folders: dict[str, str],
    path: str,
    years="all",
    domains=TARGET_DOMAINS,
    allowed=CRAWL_YEARS,
    mode: str = "append",
    glob: str = "*.parquet",
) -> dict[str, int]:
    """Load the index files of some years in one job; returns the rows of each year.

    ``append`` adds to what is there, ``replace`` swaps the years in one step. Years
    without files are named in a warning and the others are loaded; if none has any,
    that is an error. ``crawl_year`` and ``base_domain`` of the files are replaced.
    """
    if mode not in ("append", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    wanted = resolve_years(years, allowed)
    present = [y for y in wanted if y in folders and fnmatch.filter(files.names(spark, folders[y]), glob)]
    absent = [y for y in wanted if y not in present]
    if not present:
        raise FileNotFoundError(f"no index files of crawl year(s) {absent}")
    if absent:
        warnings.warn(f"no index files of crawl year(s) {absent}; the others are loaded", stacklevel=2)
    reader = spark.read.option("pathGlobFilter", glob).option("mergeSchema", "true")
    frames = {y: reader.parquet(folders[y]) for y in present}
    schema = reduce(merged, [f.schema for f in frames.values()], table_schema(spark, path) or T.StructType())
    rows = reduce(
        DataFrame.unionByName,
        [f.select(*_fitted(f, schema)).withColumn(loads.YEAR, F.lit(y)) for y, f in frames.items()],
    )
    has_key = KEY in schema.fieldNames()
    labelled = rows.withColumn(dom.LABEL, label(domains) if has_key else F.lit(None).cast("string"))
    counts = {y: F.count_if(F.col(loads.YEAR) == y) for y in present}
    replaces = present if mode == "replace" else ()
    return store.add_rows(labelled, path, [KEY] if has_key else [], "index", counts, replaces, schema)

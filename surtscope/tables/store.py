"""Writing, splitting, migrating and publishing capture tables.

Tables are Parquet folders partitioned by crawl year and domain. Nothing is
updated in place. Loads and streams write whole loads (see ``loads``), which readers
see all or nothing of; a migrated table is written beside the old one, its row count
is checked, and a catalog view is switched to it. The old rows stay until someone
removes them, so a lost executor or a failed job never loses data.
"""

from __future__ import annotations

import math
import uuid
import warnings
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from surtscope.config import CRAWL_YEARS, TARGET_DOMAINS, YEAR_FOLDER_PREFIX, resolve_years
from surtscope.functions import urls
from surtscope.operators import domains as dom
from surtscope.operators.reconcile import absent_from
from surtscope.plans.dns import DNS
from surtscope.sources import cdxj
from surtscope.tables import files, loads
from surtscope.tables.files import exists, mark, remove  # noqa: F401

PARTITIONS = ["crawl_year", "base_domain"]
#: A capture is its place in an archive file; two records of one moment stay apart.
CAPTURE_KEY = ["surtkey", "fetch_timestamp", "url", "warc_filename", "offset"]
#: Up to so many files of a split are a task each; beyond, a task cuts several or this many rows.
_SPLIT_TASKS, _ROWS_PER_TASK = 200, 1_000_000


def table_schema():
    """Schema of a table written by :func:`enrich` + :func:`write`."""
    return cdxj.capture_schema([*urls.DERIVED_COLUMNS, "base_domain"])


def domain_label(surtkey: str = "surtkey", domains=TARGET_DOMAINS):
    return F.coalesce(dom.surt_domain(surtkey, domains), F.lit("other"))


def enrich(captures: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    """Add what reports would otherwise recompute per row, and the domain label."""
    return urls.with_derived_columns(captures).withColumn(
        "base_domain", domain_label("surtkey", domains)
    )


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a table with a given schema: a year stays a string, columns keep their order.
    Of a table made of loads, the rows that count now."""
    schema = schema or table_schema()
    table = loads.live(spark, path)
    if table is not None:
        return loads.read(spark, path, schema, table)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def _laid_out(df: DataFrame, partitions: list[str], sort: list[str]) -> DataFrame:
    """Few files per partition, and several tasks for a partition that is huge.

    The rebalance hint lets AQE split a domain that holds a third of all rows
    and merge small ones. Sorting by SURT key puts similar strings together,
    which compresses well, and lets key-prefix filters skip pages of a file.
    """
    return df.hint("rebalance", *partitions).sortWithinPartitions(*partitions, *sort)


def _save_observed(
    df: DataFrame, path: str, mode: str, partitions: list[str], metrics: dict[str, Column], rows_per_file: int = 0
) -> dict:
    """Write, and return the aggregates of what was written without a second scan. A task
    begins a new file after ``rows_per_file`` rows, if given.

    They are taken from the rows as they reach the writer: below a shuffle, adaptive
    execution may drop them together with a stage that turned out empty.
    """
    seen = Observation()
    named = [c.alias(name) for name, c in metrics.items()]
    writer = df.observe(seen, *named).write.mode(mode).option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)
    return seen.get


def _save(df: DataFrame, path: str, mode: str, partitions: list[str], rows_per_file: int = 0) -> int:
    """Write and count."""
    return _save_observed(df, path, mode, partitions, {"rows": F.count(F.lit(1))}, rows_per_file)["rows"]


def new_load_name() -> str:
    return f"job-{uuid.uuid4().hex}"


def stage_load(df: DataFrame, path: str, name: str) -> int:
    """Write rows as one load that does not count yet; returns the rows written."""
    loads.begin(df.sparkSession, path)
    return _save(df, loads.folder(path, name), "overwrite", PARTITIONS)


def _add_load(df: DataFrame, path: str, name: str, source: str, replaces=()) -> int:
    """Write rows as one load and make it count."""
    written = stage_load(df, path, name)
    loads.publish(df.sparkSession, path, name, source, replaces)
    return written


def write(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    partitions: list[str] | None = None,
    sort: list[str] | None = None,
) -> int:
    """Write or append a table and return the rows written, without a second scan.

    Appending to a table made of loads adds a load.
    """
    partitions = PARTITIONS if partitions is None else partitions
    sort = [c for c in (sort or ["surtkey"]) if c in df.columns]
    rows = _laid_out(df, partitions, sort) if partitions else df
    if mode == "append" and partitions == PARTITIONS and loads.live(df.sparkSession, path) is not None:
        return _add_load(rows, path, new_load_name(), "append")
    return _save(rows, path, mode, partitions)


def wide_captures(typed: DataFrame, domains=TARGET_DOMAINS) -> DataFrame:
    """Typed records in the layout and with the columns of a captures table.

    Only the narrow records are shuffled and sorted; the 26 derived columns are
    computed afterwards, in the tasks that write them.
    """
    labelled = typed.withColumn("base_domain", domain_label("surtkey", domains))
    laid_out = _laid_out(labelled, PARTITIONS, ["surtkey"])
    wide = urls.with_all_surt_columns(urls.with_url_columns(laid_out))
    return wide.select(*[f.name for f in table_schema().fields])


def write_captures(
    typed: DataFrame, path: str, domains=TARGET_DOMAINS, mode: str = "errorifexists"
) -> int:
    """Write typed records as a captures table."""
    return _save(wide_captures(typed, domains), path, mode, PARTITIONS)


def add_rows(
    df: DataFrame,
    path: str,
    sort: list[str],
    source: str,
    metrics: dict[str, Column],
    replaces=(),
    schema=None,
    note: str | None = None,
) -> dict:
    """Add rows that carry their year and domain to a table as one load; ``schema`` and
    ``note`` become the table's in the same step. Returns the aggregates ``metrics``."""
    name = new_load_name()
    loads.begin(df.sparkSession, path)
    written = _save_observed(
        _laid_out(df, PARTITIONS, sort), loads.folder(path, name), "overwrite", PARTITIONS, metrics
    )
    loads.publish(df.sparkSession, path, name, source, replaces, schema, note)
    return written


def add_captures(
    typed: DataFrame, path: str, name: str, source: str, domains=TARGET_DOMAINS, replaces=()
) -> int:
    """Add typed records to a captures table as one load."""
    return _add_load(wide_captures(typed, domains), path, name, source, replaces)


def stage_lines(lines: DataFrame, path: str, domains=TARGET_DOMAINS) -> DataFrame:
    """Parse lines once and write what became of them; a second attempt overwrites."""
    parsed = cdxj.outcomes(lines, domains)
    parsed.write.mode("overwrite").option("compression", "zstd").partitionBy("outcome").parquet(path)
    return lines.sparkSession.read.schema(parsed.schema).parquet(path)


def write_quarantine(staged: DataFrame, quarantine: str, name: str) -> None:
    """The broken lines of one load, in a folder that a second attempt overwrites."""
    writer = cdxj.errors_of(staged).write.mode("overwrite").option("header", "true")
    writer.partitionBy("crawl_year").csv(f"{quarantine}/{loads.LOAD}={name}")


def read_quarantine(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """Broken lines of the loads that count now: ``file, line, error_type, error_message,
    raw_line_preview, crawl_year``. Lines of a load that died half way are left out."""
    quarantine = quarantine or f"{path.rstrip('/')}-errors"
    text = ", ".join(f"{c} {'long' if c == 'line' else 'string'}" for c in [*cdxj.ERROR_COLUMNS, "crawl_year", loads.LOAD])
    rows = spark.read.schema(text).option("header", "true").csv(quarantine)
    rows = rows.withColumn("raw_line_preview", F.coalesce("raw_line_preview", F.lit("")))  # empty lines
    table = loads.live(spark, path) or loads.Live()
    dead = [(F.col(loads.LOAD) == n) & F.col("crawl_year").eqNullSafe(y) for n, y in loads.hidden_parts(table)]
    listed = rows.where(F.col(loads.LOAD).isin(*table.names()))
    return reduce(lambda df, c: df.where(~c), dead, listed).drop(loads.LOAD)


def _clear_quarantine(spark: SparkSession, path: str, quarantine: str) -> None:
    """Remove broken lines of years that later loads replaced."""
    for name, year in loads.hidden_parts(loads.live(spark, path)):
        remove(spark, f"{quarantine}/{loads.LOAD}={name}/crawl_year={year}")


def append(df: DataFrame, path: str, partitions: list[str] | None = None) -> int:
    """Append by column name: the frame is put in the table's column order."""
    spark = df.sparkSession
    known = loads.live(spark, path) is not None
    target = read(spark, path).columns if known else spark.read.parquet(path).columns
    missing = set(target) - set(df.columns)
    if missing:
        raise ValueError(f"frame lacks table columns {sorted(missing)}")
    return write(df.select(*target), path, "append", partitions)


def load_years(
    spark: SparkSession,
    data_dir: str,
    path: str,
    years="all",
    domains=TARGET_DOMAINS,
    allowed: Iterable[str] = CRAWL_YEARS,
    glob: str = "*.cdxj.gz",
    prefix: str = YEAR_FOLDER_PREFIX,
    mode: str = "append",
    quarantine: str | None = None,
) -> int:
    """Load the CDXJ files of some years in one job; returns rows written.

    Lines are parsed once, into a staged folder by outcome from which the load and
    its quarantine are written. ``append`` adds to what is there, so loading a year
    twice doubles it; ``replace`` swaps the loaded years in one step and can be
    repeated: readers see the old years or the new ones, whole. A row's year is the
    year of the folder that was asked for. Years without a folder are named in a
    warning and the others are loaded; if there is none at all, that is an error.
    Broken lines go to the CSV folder ``quarantine``, ``<path>-errors`` if none is
    named, each load to a folder of its own; those of replaced years are removed.
    """
    wanted = resolve_years(years, allowed)
    folders = dict(zip(wanted, cdxj.year_folders(data_dir, wanted, allowed, prefix)))
    absent = [y for y, folder in folders.items() if not exists(spark, folder)]
    if len(absent) == len(wanted):
        raise FileNotFoundError(f"no folder of crawl year(s) {absent} in {data_dir}")
    if absent:
        warnings.warn(f"no folder of crawl year(s) {absent} in {data_dir}; the others are loaded", stacklevel=2)
    present = [y for y in wanted if y not in absent]
    lines = reduce(
        DataFrame.unionByName,
        [cdxj.read_lines(spark, folders[y], glob, True).withColumn("crawl_year", F.lit(y)) for y in present],
    )
    if mode in ("errorifexists", "error") and exists(spark, path):
        raise ValueError(f"{path} exists already")
    if mode not in ("append", "replace", "errorifexists", "error"):
        raise ValueError(f"unknown mode {mode!r}")
    name, quarantine = new_load_name(), quarantine or f"{path.rstrip('/')}-errors"
    staged_path = f"{path}/_staged/{name}"
    staged = stage_lines(lines, staged_path, domains)
    typed = cdxj.typed_records(cdxj.records_of(staged), F.col("crawl_year"))
    loads.write_file_list(staged.select("file", "crawl_year"), path, name)
    write_quarantine(staged, quarantine, name)
    written = add_captures(typed, path, name, "load", domains, present if mode == "replace" else ())
    _clear_quarantine(spark, path, quarantine)
    remove(spark, staged_path)
    return written


def convert_cdxj(lines: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """CDXJ to Parquet with the 13 raw columns; bad lines drop out.

    Map-only: each task writes the files of the shards it read.
    """
    return write(cdxj.records(lines, typed=False).select(
        *[F.col(f"`{c}`") for c in cdxj.RAW_COLUMNS]
    ), path, mode, partitions=[])


def split_by_domain(
    df: DataFrame,
    path: str,
    domains=TARGET_DOMAINS,
    surtkey: str = "surtkey",
    mode: str = "errorifexists",
    rows_per_file: int | None = None,
) -> int:
    """One partition folder per target domain, written in a single pass.

    With ``rows_per_file`` the files of a domain hold ranges of keys that do not overlap
    and have about that many rows each: a filter on a host or path prefix then opens the
    files of its range only. Within a key larger than a file the ranges go on by time and
    offset. Few files are cut at sampled keys; of many, the sample would be as large as the
    table, so each task gets a longer range and cuts its sorted rows into files.
    """
    labelled = df.withColumn("base_domain", dom.surt_domain(surtkey, domains)).where(
        F.col("base_domain").isNotNull()
    )
    if rows_per_file is None:
        return write(labelled, path, mode, ["base_domain"], [surtkey])
    order = ["base_domain", surtkey, *[c for c in ("fetch_timestamp", "offset") if c in df.columns]]
    rows = labelled.count()
    ranges = wanted = max(1, math.ceil(rows / rows_per_file))
    if wanted > _SPLIT_TASKS:
        ranges = min(wanted, max(min(wanted // 8, _SPLIT_TASKS), math.ceil(rows / _ROWS_PER_TASK)))
    laid_out = labelled.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return _save(laid_out, path, mode, ["base_domain"], rows_per_file if ranges < wanted else 0)


def read_domain(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """One domain of a split table; other folders are pruned."""
    return spark.read.parquet(path).where(F.col("base_domain") == domain)


class SchemaMismatch(ValueError):
    """Source and target tables do not have the same columns in the same order."""


def check_same_columns(source: DataFrame, target: DataFrame) -> None:
    if source.columns == target.columns:
        return
    missing = sorted(set(source.columns) - set(target.columns))
    extra = sorted(set(target.columns) - set(source.columns))
    raise SchemaMismatch(
        f"columns differ (missing in target: {missing}, only in target: {extra}, or order)"
    )


def migrate_surt_columns(df: DataFrame, path: str, partitions: list[str] | None = None) -> str | None:
    """Write ``df`` with all SURT columns to ``path``; None if there is nothing to do.

    A partial set of SURT columns is recomputed. The copy keeps the layout by year
    and domain where ``df`` has these columns (``[]`` writes a flat table). It must
    hold as many rows as were written; the second count comes from Parquet footers.
    """
    if set(urls.SURT_COLUMNS) <= set(df.columns):
        return None
    if "surtkey" not in df.columns:
        raise ValueError("table has no surtkey column to derive from")
    spark = df.sparkSession
    bare = df.drop(*[c for c in urls.SURT_COLUMNS if c in df.columns])
    if partitions is None:
        partitions = [c for c in PARTITIONS if c in df.columns]
    before = write(urls.with_surt_columns(bare), path, "errorifexists", partitions)
    after = spark.read.parquet(path).count()
    if before != after:
        raise RuntimeError(f"row count changed during migration: {before} -> {after}")
    return path


def publish(spark: SparkSession, name: str, path: str) -> None:
    """Point the catalog view ``name`` at a finished table folder, in one step.

    Partition values are read from folder names; the view keeps them strings. A view
    of a table made of loads shows the loads that count now.
    """
    if loads.live(spark, path) is not None:
        query = loads.view_sql(spark, path, table_schema().fieldNames())
    else:
        columns = ", ".join(
            f"CAST(`{c}` AS STRING) AS `{c}`" if c in PARTITIONS else f"`{c}`"
            for c in spark.read.parquet(path).columns
        )
        query = f"SELECT {columns} FROM parquet.`{path}`"
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {query}")


def create_temp_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def materialise(df: DataFrame, path: str, partitions: list[str] | None = None) -> DataFrame:
    """Write an intermediate result once and read it back from its folder."""
    write(df, path, "errorifexists", partitions or [], [])
    return df.sparkSession.read.schema(df.schema).parquet(path)


def backfill_dns(
    spark: SparkSession,
    lines: DataFrame,
    path: str,
    crawl_year,
    domains=TARGET_DOMAINS,
) -> int:
    """Append the DNS records of CDXJ lines that a table does not hold yet.

    Records are compared by their capture key, so a second run adds nothing and a
    run that died half way is completed by the next one.
    """
    table = read(spark, path)
    found = enrich(cdxj.captures(cdxj.dns_records(lines), crawl_year, domains), domains)
    return append(absent_from(found, table.where(F.col("mime") == DNS), CAPTURE_KEY), path)


def propagate_dns(
    source: DataFrame, path: str, domain: str, schema=None
) -> int:
    """Copy one domain's DNS rows that its own table lacks from the full table."""
    spark = source.sparkSession
    target = read(spark, path, schema) if schema else spark.read.parquet(path)
    check_same_columns(source, target)
    wanted = source.where((F.col("mime") == DNS) & dom.is_one_domain("surtkey", domain))
    fresh = absent_from(wanted, target.where(F.col("mime") == DNS), CAPTURE_KEY)
    return write(fresh.select(*target.columns), path, "append", [], [])


def propagate_dns_all(source: DataFrame, root: str, domains=TARGET_DOMAINS) -> dict[str, int]:
    """Copy the DNS rows that the tables of a split (``base_domain=…`` below ``root``) lack
    from the full table: one scan of it and one append for all domains.

    Returns the rows added to each domain. Every target's columns are checked before
    anything is written; domains without a table are named in a warning. A second run
    adds nothing, and one that died half way is completed by the next.
    """
    spark = source.sparkSession
    present = [d for d in domains if exists(spark, f"{root}/base_domain={d}")]
    if len(present) < len(domains):
        warnings.warn(f"no table of domain(s) {sorted(set(domains) - set(present))}", stacklevel=2)
    wide = source.drop("base_domain")
    problems = []
    for domain in present:
        try:
            check_same_columns(wide, spark.read.parquet(f"{root}/base_domain={domain}"))
        except SchemaMismatch as mismatch:
            problems.append(f"{domain}: {mismatch}")
    if problems:
        raise SchemaMismatch("; ".join(problems))
    if not present:
        return {}
    label = dom.surt_domain("surtkey", domains)
    wanted = wide.where(F.col("mime") == DNS).withColumn("base_domain", label)
    schema = wanted.schema
    target = spark.read.schema(schema).parquet(root)
    here = F.col("base_domain").isin(*present)
    key = ["base_domain", *CAPTURE_KEY]
    fresh = absent_from(wanted.where(here), target.where(here & (F.col("mime") == DNS)), key)
    laid_out = _laid_out(fresh, ["base_domain"], ["surtkey"])
    return _save_observed(
        laid_out, root, "append", ["base_domain"], {d: F.count_if(F.col("base_domain") == d) for d in present}
    )


def ensure_table(spark: SparkSession, path: str, schema=None) -> None:
    """Create an empty table folder; appending nothing leaves an existing one as it is."""
    spark.createDataFrame([], schema or table_schema()).write.mode("append").partitionBy(
        *PARTITIONS
    ).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Export a report, or the quarantine table, with a header line."""
    df.write.mode(mode).option("header", "true").csv(path)

"""Incremental loading of capture files with Structured Streaming.

The stream checkpoint remembers which files were loaded, so a second run picks up
only new ones. Each micro-batch is parsed once into a staged folder and becomes one
load of the table (see ``tables.loads``), named after the query and the batch: the
query's id is kept in its checkpoint, so a batch that runs again finds its load listed
and does nothing, or overwrites what a first attempt left half written, while a new
checkpoint never takes a batch of an older one for its own.

Each load keeps the names of the files it read. Files that loads of other queries, or
batch loads, have read are not loaded again, so a lost checkpoint costs a listing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from surtscope.config import TARGET_DOMAINS, YEAR_IN_PATH
from surtscope.operators.reconcile import absent_from, with_keys_of
from surtscope.sources import cdxj
from surtscope.tables import files, loads, store

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def capture_stream(
    spark: SparkSession,
    folder: str,
    glob: str = "*.cdxj.gz",
    year_pattern: str = YEAR_IN_PATH,
    files_per_batch: int = 1000,
) -> DataFrame:
    """Streaming lines of all files below a folder: ``value, file, crawl_year``; the year
    is NULL where the path names none."""
    lines = (
        spark.readStream.option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .text(folder)
        .select("value", F.col("_metadata.file_path").alias("file"))
    )
    year = F.nullif(cdxj.year_from_path("file", year_pattern), F.lit(""))
    return lines.withColumn("crawl_year", year)


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the query that owns a checkpoint folder."""
    return json.loads(files.read_text(spark, f"{checkpoint}/metadata"))["id"]


def _run(stream: DataFrame, batch_function, checkpoint: str) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(batch_function)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _unread(lines: DataFrame, path: str, source: str) -> DataFrame:
    """Lines of files that no other query's load, and no batch load, has read."""
    spark = lines.sparkSession
    table = loads.live(spark, path)
    known = loads.known_files(spark, path, table.not_from(source)) if table else None
    return lines if known is None else lines.join(known, "file", "left_anti")


def _stage(batch: DataFrame, path: str, source: str, staged: str, domains) -> DataFrame:
    numbered = batch.withColumn("row", F.monotonically_increasing_id())
    return store.stage_lines(_unread(numbered, path, source), staged, domains)


def load_new_files(
    stream: DataFrame, path: str, checkpoint: str, domains=TARGET_DOMAINS, quarantine: str | None = None
) -> StreamingQuery:
    """Load everything that is new, then stop. Returns the finished query.

    Broken lines go to ``quarantine``, ``<path>-errors`` if none is named, in a
    folder for each load that a second attempt overwrites.
    """
    quarantine = quarantine or f"{path.rstrip('/')}-errors"

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        source = _query_id(spark, checkpoint)
        name = f"stream-{source}-{batch_id}"
        table = loads.live(spark, path)
        if table and name in table.names():
            return
        staged_path = f"{path}/_staged/{name}"
        staged = _stage(batch, path, source, staged_path, domains)
        typed = cdxj.typed_records(cdxj.records_of(staged), F.col("crawl_year"))
        loads.write_file_list(staged.select("file", "crawl_year"), path, name)
        store.write_quarantine(staged, quarantine, name)
        store.add_captures(typed, path, name, source, domains)
        store.remove(spark, staged_path)

    store.ensure_table(stream.sparkSession, path)
    return _run(stream, load, checkpoint)


def _stage_new_lines(stream: DataFrame, path: str, checkpoint: str, domains, quarantine: str) -> str:
    """First half of :func:`append_unseen`: parse what is new into ``batch=…`` folders."""
    staged, own = f"{checkpoint}/staged", f"{checkpoint}/lines"

    def stage(batch: DataFrame, batch_id: int) -> None:
        source = _query_id(batch.sparkSession, own)
        rows = _stage(batch, path, source, f"{staged}/batch={batch_id}", domains)
        store.write_quarantine(rows, quarantine, f"stream-{source}-{batch_id}")

    files.make_folder(stream.sparkSession, staged)
    _run(stream, stage, own)
    return staged


def append_unseen(
    stream: DataFrame, path: str, checkpoint: str, domains=TARGET_DOMAINS, quarantine: str | None = None
) -> StreamingQuery:
    """Append only captures whose key the table does not hold yet.

    Two queries share the checkpoint folder. The first parses new files into a staged
    folder. The second streams the staged records through a keyed state store, which
    passes each capture key once, so a run costs what its new files hold however large
    the table has grown. Only rows that others put into the table (batch loads, or a
    query whose checkpoint was lost) are looked up in it, in the crawl years at hand,
    as the state does not know them.
    """
    spark = stream.sparkSession
    store.ensure_table(spark, path)
    staged = _stage_new_lines(stream, path, checkpoint, domains, quarantine or f"{path.rstrip('/')}-errors")
    own, key = f"{checkpoint}/keys", store.CAPTURE_KEY
    staged_schema = spark.createDataFrame([], "value string, file string, row long, crawl_year string")
    schema = cdxj.outcomes(staged_schema).schema.add("batch", "long")
    rows = spark.readStream.schema(schema).parquet(staged).drop("batch")
    typed = cdxj.typed_records(cdxj.records_of(rows), F.col("crawl_year"))

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        source = _query_id(session, own)
        name = f"stream-{source}-{batch_id}"
        table = loads.live(session, path)
        if table and name in table.names():
            return
        passed = f"{path}/_staged/{name}"
        batch.write.mode("overwrite").parquet(passed)  # the state store is asked once
        fresh = session.read.schema(batch.schema).parquet(passed)
        foreign = (table or loads.Live()).not_from(source)
        if table is None or any(load.live_years() for load in foreign.loads):
            known = store.read(session, path) if table is None else loads.read(session, path, store.table_schema(), foreign)
            years = fresh.select("crawl_year").distinct()
            at_hand = known.join(years, known.crawl_year.eqNullSafe(years.crawl_year), "left_semi")
            fresh = absent_from(fresh, with_keys_of(at_hand, fresh, key), key)
        store.add_captures(fresh, path, name, source, domains)
        store.remove(session, passed)

    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKSDB)  # keys live on disk, not in executor memory
    try:
        query = _run(typed.dropDuplicates(key), add, own)
    finally:
        spark.conf.set(_STATE_STORE, before)
    if files.names(spark, staged):
        _note_files(spark, path, staged, _query_id(spark, f"{checkpoint}/lines"))
    return query


def _note_files(spark: SparkSession, path: str, staged: str, source: str) -> None:
    """Once all rows of staged batches are in the table, list them as loads that have read
    their files and hold no rows, and drop the staged rows. If a run dies before, the keys
    alone keep rows from coming twice."""
    for batch in sorted(files.names(spark, staged)):
        name = f"stream-{source}-{batch.removeprefix('batch=')}"
        rows = spark.read.schema("file string, crawl_year string, outcome string").parquet(f"{staged}/{batch}")
        loads.write_file_list(rows.select("file", "crawl_year"), path, name)
        loads.publish(spark, path, name, source)
        files.remove(spark, f"{staged}/{batch}")

"""CDXJ capture lines: ``surtkey timestamp {json}``, one capture per line.

A ``.gz`` file is read by one task from start to end, many small files share a
task (``spark.sql.files.maxPartitionBytes`` / ``openCostInBytes`` pack them),
and parsing is ``split`` + ``from_json`` on the JVM.

The parser is strict: a line is good only if it has three tokens and the third
is exactly one JSON object. ``from_json`` alone accepts trailing garbage, so
the blob is parsed inside an array that must come out with one element; a blob
that contains ``]`` is also parsed inside an object. Text that closes the array
early cannot also close the object, so together the two tests are exact.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surtscope.config import CRAWL_YEARS, YEAR_FOLDER_PREFIX, YEAR_IN_PATH, resolve_years
from surtscope.functions import urls
from surtscope.operators import domains as dom
from surtscope.operators.fences import computed_once

# JSON keys kept from a capture line.
JSON_KEYS = (
    "url",
    "mime",
    "status",
    "digest",
    "length",
    "offset",
    "filename",
    "mime-detected",
    "puid",
    "charset",
    "languages",
)
RECORD = T.StructType([T.StructField(k, T.StringType()) for k in JSON_KEYS])
RAW_COLUMNS = [*JSON_KEYS, "surtkey", "timestamp"]

_WHITESPACE = " \t\r\n\f\v"
_JSON_OPTIONS = {"allowSingleQuotes": "false"}
_PREVIEW = 200


def read_lines(
    spark: SparkSession,
    paths: str | list[str],
    glob: str = "*.cdxj.gz",
    recursive: bool = False,
    base_path: str | None = None,
) -> DataFrame:
    """``value, file, row`` for every line.

    ``row`` grows by one per line within a file because a gzip file is never
    split; do not use it with plain-text input.
    """
    reader = spark.read.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if base_path:
        reader = reader.option("basePath", base_path)
    return reader.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("row"),
    )


def year_folders(
    data_dir: str,
    years="all",
    allowed: Iterable[str] = CRAWL_YEARS,
    prefix: str = YEAR_FOLDER_PREFIX,
) -> list[str]:
    """One folder per requested crawl year, unknown years rejected."""
    return [f"{data_dir}/{prefix}{y}" for y in resolve_years(years, allowed)]


def year_from_path(file: Column | str = "file", pattern: str = YEAR_IN_PATH) -> Column:
    return F.regexp_extract(file, pattern, 1)


def _opens_object(blob: Column) -> Column:
    return F.btrim(blob, F.lit(_WHITESPACE)).startswith("{")


def _parse(lines: DataFrame) -> DataFrame:
    """Split each line and parse its JSON once; keeps every input column.

    Filters on the key or the token count run before the parsing, filters on
    the parsed record after it.
    """
    trimmed = F.btrim(F.col("value"), F.lit(_WHITESPACE))
    split = lines.withColumn("_tokens", F.split(trimmed, " ", 3))
    blob = F.get(F.col("_tokens"), F.lit(2))
    in_array = F.from_json(
        F.concat(F.lit("["), blob, F.lit("]")), T.ArrayType(RECORD), _JSON_OPTIONS
    )
    parsed = computed_once(
        split, {"_blob": blob, "_array": F.when(_opens_object(blob), in_array)}
    )
    in_object = F.from_json(
        F.concat(F.lit('{"r":'), F.col("_blob"), F.lit("}")),
        T.StructType(
            [T.StructField("r", RECORD), T.StructField("_bad", T.StringType())]
        ),
        {**_JSON_OPTIONS, "columnNameOfCorruptRecord": "_bad"},
    )
    one_object = (F.size("_array") == 1) & (
        ~F.contains(F.col("_blob"), F.lit("]")) | in_object["_bad"].isNull()
    )
    return parsed.withColumns(
        {
            "_record": F.get(F.col("_array"), F.lit(0)),
            "_token_count": F.size("_tokens"),
            "_good": F.coalesce((F.size("_tokens") == 3) & one_object, F.lit(False)),
        }
    )


def _castable(record: Column) -> Column:
    """Numeric fields must convert; absent fields are fine."""
    def ok(name: str, kind: str) -> Column:
        return record[name].isNull() | record[name].try_cast(kind).isNotNull()

    return ok("status", "int") & ok("length", "bigint") & ok("offset", "bigint")


def records(lines: DataFrame, typed: bool = True) -> DataFrame:
    """Good lines as the 13 raw string columns, plus the columns of ``lines``.

    ``typed`` also drops lines whose numeric fields do not convert, which is
    what a load needs; those lines are in :func:`errors`.
    """
    parsed = _parse(lines).where((F.col("_token_count") == 3) & F.col("_good"))
    if typed:
        parsed = parsed.where(_castable(F.col("_record")))
    kept = [c for c in lines.columns if c != "value"]
    return parsed.select(
        *[F.col("_record")[k].alias(k) for k in JSON_KEYS],
        F.get(F.col("_tokens"), F.lit(0)).alias("surtkey"),
        F.get(F.col("_tokens"), F.lit(1)).alias("timestamp"),
        *kept,
    )


def _classified(lines: DataFrame, typed: bool = True) -> DataFrame:
    """Parsed lines with ``error_type, error_message``, NULL for good ones."""
    parsed = _parse(lines)
    blob = F.col("_blob")
    other_json = ~_opens_object(blob) & (
        F.json_array_length(F.concat(F.lit("["), blob, F.lit("]"))) == 1
    )
    conversion = F.col("_good") & ~_castable(F.col("_record")) if typed else F.lit(False)
    kind = (
        F.when(F.col("_token_count") != 3, "ValueError")
        .when(~F.col("_good") & F.coalesce(other_json, F.lit(False)), "TypeError")
        .when(~F.col("_good"), "JSONDecodeError")
        .when(conversion, "ConversionError")
    )
    message = (
        F.when(
            F.col("error_type") == "ValueError",
            F.format_string(
                "not enough values to unpack (expected 3, got %d)", F.col("_token_count")
            ),
        )
        .when(F.col("error_type") == "TypeError", "third token is JSON but not an object")
        .when(F.col("error_type") == "JSONDecodeError", "third token is not one JSON object")
        .when(F.col("error_type") == "ConversionError", "status, length or offset is not an integer")
    )
    return parsed.withColumn("error_type", kind).withColumn("error_message", message)


def _preview() -> Column:
    return F.substring(F.btrim(F.col("value"), F.lit(_WHITESPACE)), 1, _PREVIEW)


ERROR_COLUMNS = ["file", "line", "error_type", "error_message", "raw_line_preview"]


def errors(lines: DataFrame, typed: bool = True) -> DataFrame:
    """Quarantined lines: ``file, line, error_type, error_message, raw_line_preview``.

    One scan. Good lines collapse to one row per file and task before the
    shuffle and only tell where the file starts; a bad line keeps its own row,
    and its line number is its distance from that start.
    """
    marked = _classified(lines, typed)
    bad = F.col("error_type").isNotNull()
    per_line = marked.groupBy(
        "file",
        F.when(bad, F.col("row")).alias("bad_row"),
        "error_type",
        "error_message",
        F.when(bad, _preview()).alias("raw_line_preview"),
    ).agg(F.min("row").alias("row"))
    start = F.min("row").over(Window.partitionBy("file"))
    return (
        per_line.withColumn("_start", start)
        .where(F.col("bad_row").isNotNull())
        .withColumn("line", F.col("bad_row") - F.col("_start") + 1)
        .select(*ERROR_COLUMNS)
    )


RECORD_LINE, OTHER_LINE, BROKEN_LINE = "record", "other", "broken"


def outcomes(lines: DataFrame, domains=None) -> DataFrame:
    """Every line once, parsed once, with its ``outcome``.

    ``record`` rows carry the raw record columns, ``broken`` rows what the quarantine
    needs, ``other`` rows (good lines of domains that are not wanted) only their file
    and row, from which line numbers are counted. Columns of ``lines`` but the text stay.
    """
    marked = _classified(lines)
    key = F.get(F.col("_tokens"), F.lit(0))
    wanted = F.lit(True) if domains is None else dom.surt_domain(key, domains).isNotNull()
    outcome = (
        F.when(F.col("error_type").isNotNull(), BROKEN_LINE).when(wanted, RECORD_LINE).otherwise(OTHER_LINE)
    )
    split = computed_once(marked, {"outcome": outcome})
    of_record = lambda c: F.when(F.col("outcome") == RECORD_LINE, c)
    return split.select(
        *[of_record(F.col("_record")[k]).alias(k) for k in JSON_KEYS],
        of_record(key).alias("surtkey"),
        of_record(F.get(F.col("_tokens"), F.lit(1))).alias("timestamp"),
        *[c for c in lines.columns if c != "value"],
        "error_type",
        "error_message",
        F.when(F.col("outcome") == BROKEN_LINE, _preview()).alias("raw_line_preview"),
        "outcome",
    )


def records_of(staged: DataFrame) -> DataFrame:
    """The records among written :func:`outcomes`, as :func:`records` gives them."""
    dropped = ("error_type", "error_message", "raw_line_preview", "outcome")
    return staged.where(F.col("outcome") == RECORD_LINE).drop(*dropped)


def errors_of(staged: DataFrame) -> DataFrame:
    """The quarantine among written :func:`outcomes`, with the crawl year of each line."""
    starts = staged.groupBy("file").agg(F.min("row").alias("_start"))
    broken = staged.where(F.col("outcome") == BROKEN_LINE)
    return (
        broken.join(starts, "file")
        .withColumn("line", F.col("row") - F.col("_start") + 1)
        .select(*ERROR_COLUMNS, "crawl_year")
    )


def error_type_counts(quarantine: DataFrame) -> DataFrame:
    return (
        quarantine.groupBy("error_type")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "error_type")
    )


def typed_records(raw: DataFrame, crawl_year: Column | str, domains=None) -> DataFrame:
    """Raw records with table names and types, still without derived columns.

    ``domains`` keeps the rows of these target domains only.
    """
    year = F.lit(crawl_year) if isinstance(crawl_year, str) else crawl_year
    kept = raw if domains is None else dom.only_targets(raw, domains)
    return kept.select(
        "url",
        "mime",
        F.col("status").cast("int").alias("status"),
        "digest",
        F.col("length").cast("bigint").alias("length"),
        F.col("offset").cast("bigint").alias("offset"),
        F.col("filename").alias("warc_filename"),
        F.col("`mime-detected`").alias("mime_detected"),
        "puid",
        "charset",
        "languages",
        "surtkey",
        F.col("timestamp").alias("fetch_timestamp"),
        year.alias("crawl_year"),
    )


def typed_schema() -> T.StructType:
    """The columns of :func:`typed_records`."""
    derived = {*urls.URL_COLUMNS, *urls.SURT_COLUMNS} - {"surtkey"}
    return T.StructType([f for f in capture_schema().fields if f.name not in derived])


def widen(typed: DataFrame) -> DataFrame:
    """Typed records to the 34-column captures table, in its fixed column order."""
    return urls.with_surt_columns(urls.with_url_columns(typed)).select(*CAPTURE_COLUMNS)


def captures(raw: DataFrame, crawl_year: Column | str, domains=None) -> DataFrame:
    return widen(typed_records(raw, crawl_year, domains))


def dns_lines(lines: DataFrame) -> DataFrame:
    """Lines that can hold a DNS record: a substring test before any parsing."""
    return lines.where(F.contains(F.col("value"), F.lit('"url":"dns:')))


def dns_records(lines: DataFrame) -> DataFrame:
    return records(dns_lines(lines)).where(F.col("mime") == "text/dns")


CAPTURE_COLUMNS = [
    "url",
    *urls.URL_COLUMNS,
    "mime",
    "status",
    "digest",
    "length",
    "offset",
    "warc_filename",
    "mime_detected",
    "puid",
    "charset",
    "languages",
    "surtkey",
    "fetch_timestamp",
    "crawl_year",
    *urls.SURT_COLUMNS,
]
_TYPES = {"status": T.IntegerType(), "length": T.LongType(), "offset": T.LongType(), "depth": T.IntegerType()}


def capture_schema(extra: Iterable[str] = ()) -> T.StructType:
    """Schema of the captures table, for reads that must not infer types."""
    return T.StructType(
        [T.StructField(c, _TYPES.get(c, T.StringType())) for c in [*CAPTURE_COLUMNS, *extra]]
    )



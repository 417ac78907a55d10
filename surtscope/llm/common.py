"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surtscope.session import run_folder

#: The six ASCII white-space characters, as a Java and Python character class.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage with a
    copy that survives the loss of any executor."""
    spark = df.sparkSession
    path = run_folder(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``modulus``; NULL ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """The strings of a column one by one; NULL reads as ''."""
    for value in column:
        yield value.as_py() or ""


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; one number."""
    row = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()
    return int(row.n or 0)

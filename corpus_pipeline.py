"""Corpus pipeline: quality classifier, exact dedup, near-dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept; ``run`` writes each result as Parquet in the shared folder and reads it back
for the next stage. All stages but the last return the columns of ``docs``.

Defined results: NULL texts count as empty in every stage; of rows that repeat
doc_id and text one stays; rows with one doc_id and different texts are separate
documents, except that near-dedup keeps or drops all rows of a doc_id in a group;
extra columns are carried; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surtscope.llm import exact_dedup, near_texts, packing, pu_quality, secret_scan
from surtscope.llm.common import SPACE_CLASS, materialise, table
from surtscope.llm.queries import PACKING_ENCODER


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more."""
    labels = table(spark, sf_dir, "labels")
    model = pu_quality.fit(docs, labels, pu_quality.in_training(F.col("doc_id")))
    scored = pu_quality.score(docs, model, *docs.columns)
    kept = scored.where("score >= 0.5").drop("score")
    return kept.toDF(*docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The surviving row of each group of equal texts."""
    decided = exact_dedup.exact_dedup(docs).where("kept").groupBy("doc_id", "text_sha256", "n_points")
    kept = decided.agg(F.count(F.lit(1)).alias("__rows")).toDF("__id", "__sha", "__points", "__rows")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns(
        {
            "__key": F.sha2(F.regexp_replace(text, f"[{SPACE_CLASS}]+", ""), 256),
            "__length": F.length(text).cast("long"),
        }
    )
    stay = keyed.join(
        kept,
        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha")) & (F.col("__length") == F.col("__points")),
    )
    single = stay.where("__rows = 1").select(*docs.columns)
    return single.union(stay.where("__rows > 1").dropDuplicates(["doc_id", "__key"]).select(*docs.columns))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that names its group of texts with five-word Jaccard 0.8 or more."""
    groups = near_texts.near_texts(docs)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars of changed texts renewed."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = secret_scan.scan(docs, carry=carry)
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("secrets")))
    if "n_chars" in carry:
        renewed = F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", renewed)
    return clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return packing.pack_texts(docs, *PACKING_ENCODER)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact),
    ("simhash_near_dedup", drop_near),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: The classifier's fit is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Quality classifier by positive-unlabelled learning.

A linear model is fitted on trusted positives and on unlabelled web text by
minimising the non-negative unbiased risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

with logistic loss and a class prior. Negative labels are never examples; they
only help to estimate the prior, as the share of positives among trusted labels
(shrunk a little towards one half; one half without labels).

Features of a text, whole and in any language: frequencies of bytes, frequencies
of hashed byte trigrams, and a few ratios (distinct words, repeated lines, mean
word length, log length). The fit sees a bounded sample: ``max_positives``
trusted positives and ``max_unlabelled`` texts, the first by a hash of their id.
Scoring reads every text in one pass without a shuffle.

Defined results: NULL text is empty and is scored like any text; without a
positive label every score is the prior; rows with a NULL or repeated doc_id are
scored each, of rows with one sampled id one is learnt from; labels for ids that repeat
count as positive if any of them is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtscope.llm.common import crc_bucket

TRIGRAM_BUCKETS = 2048
_RATIOS = 6
N_FEATURES = 256 + TRIGRAM_BUCKETS + _RATIOS
MAX_POSITIVES = 3000
MAX_UNLABELLED = 6000


def features(text: str) -> np.ndarray:
    """Feature vector of one text."""
    out = np.zeros(N_FEATURES, np.float32)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return out
    out[:256] = np.sqrt(np.bincount(data, minlength=256) / n)
    if n >= 3:
        d = data.astype(np.uint32)
        h = (d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA6B)) ^ (d[2:] * np.uint32(0xC2B2AE35))
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(21)
        out[256 : 256 + TRIGRAM_BUCKETS] = np.sqrt(np.bincount(h, minlength=TRIGRAM_BUCKETS) / (n - 2))
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    k = max(1, len(words))
    out[-_RATIOS:] = (
        np.log1p(n) / 10,
        len(words) / n,
        len(set(words)) / k,
        1 - len(set(lines)) / max(1, len(lines)),
        len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2),
        min(5.0, len(lines) / k * 10),
    )
    return out


def fit_nnpu(
    x: np.ndarray, n_positive: int, prior: float, steps: int = 400, rate: float = 0.02, decay: float = 0.02
) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk; (weights, bias) for raw features.

    The first ``n_positive`` rows of ``x`` are positives, the others unlabelled;
    ``x`` is standardised in place, so that the sample is held once. The weights
    are the mean of those of the last half of the steps. Where the inner
    difference is negative, the step goes up its gradient alone, as non-negative
    PU learning has it.
    """
    mean = x.mean(axis=0, dtype=np.float64)
    square = np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x)
    scale = np.sqrt(np.maximum(square - mean**2, 0)) + 0.02
    x -= mean.astype(np.float32)
    x /= scale.astype(np.float32)
    n_other, size = len(x) - n_positive, x.shape[1]
    w, b = np.zeros(size), 0.0
    m, v, total = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        f = (x @ w.astype(np.float32)).astype(np.float64) + b
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        loss = np.logaddexp(0, f)
        inner = loss[n_positive:].mean() - prior * loss[:n_positive].mean()
        g = np.empty(len(x))
        if inner >= 0:
            g[:n_positive], g[n_positive:] = -prior / n_positive, s[n_positive:] / n_other
        else:
            g[:n_positive], g[n_positive:] = prior * s[:n_positive] / n_positive, -s[n_positive:] / n_other
        grad = np.r_[g.astype(np.float32) @ x + decay * w, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if step > steps // 2:
            total += np.r_[w, b]
    total /= steps - steps // 2
    weights = total[:-1] / scale
    return weights, float(total[-1] - mean @ weights)


@dataclass(frozen=True)
class QualityModel:
    """Linear score of features; ``weights`` is None if there was nothing to learn."""

    weights: np.ndarray | None
    bias: float
    prior: float

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(features(text) @ self.weights + self.bias, -30, 30))))


def _feature_rows(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                found = [features(t.as_py() or "").tobytes() for t in part.column("text")]
                columns = [part.column("id"), part.column("positive"), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "positive", "x"])

    keyed = rows.select(F.col("doc_id").cast("string").alias("id"), "positive", "text")
    return keyed.mapInArrow(run, "id string, positive boolean, x binary")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    training: Column,
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
    prior: float | None = None,
) -> QualityModel:
    """Fit on rows for which ``training`` (over doc_id) holds.

    Only the ids and labels of the bounded sample are broadcast; features of the
    sample meet in one task, and the weights alone come to the driver.
    """
    trusted = (
        labels.where(training & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    counts = trusted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quality")).alias("p")).first()
    if prior is None:
        prior = ((counts.p or 0) + 1) / (counts.n + 2)
    prior = min(max(prior, 0.01), 0.99)
    if not counts.p:
        return QualityModel(None, 0.0, prior)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen_p = trusted.where("quality = 1").select("doc_id").orderBy(*order).limit(max_positives)
    chosen_u = docs.where(training & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    chosen_u = chosen_u.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_unlabelled)
    ids = chosen_p.withColumn("positive", F.lit(True)).union(chosen_u.withColumn("positive", F.lit(False)))
    rows = _feature_rows(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"))
    sample = rows.groupBy("id", "positive").agg(F.min("x").alias("x"))  # an id with many rows adds one

    def train(table: pa.Table) -> pa.Table:
        positive = table.column("positive").to_numpy(zero_copy_only=False).astype(bool)
        if positive.all() or not positive.any():
            return pa.table({"w": pa.array([], pa.binary())})
        x = np.empty((len(positive), N_FEATURES), np.float32)
        for k, row in enumerate(table.column("x")):
            x[k] = np.frombuffer(row.as_buffer(), np.float32)
        order = np.lexsort((*x[:, -_RATIOS:].T, ~positive))  # the same sums whatever the order of arrival
        w, b = fit_nnpu(x[order], int(positive.sum()), prior)
        return pa.table({"w": pa.array([np.r_[w, b].astype(np.float64).tobytes()], pa.binary())})

    found = sample.withColumn("fit", F.lit(1)).groupBy("fit").applyInArrow(train, "w binary").first()
    if found is None:
        return QualityModel(None, 0.0, prior)
    values = np.frombuffer(bytes(found.w), np.float64)
    return QualityModel(values[:-1].copy(), float(values[-1]), prior)


def score(docs: DataFrame, model: QualityModel, *carry: str) -> DataFrame:
    """``carry`` columns (doc_id if none) and the score of every text; a carried
    column named score becomes old_score."""
    carry = carry or ("doc_id",)
    own = "text" in carry
    frame = docs.select(*carry) if own else docs.select(*carry, F.col("text").alias("__pu_text"))
    kept = frame.drop("__pu_text").withColumnRenamed("score", "old_score").schema
    place = list(carry).index("text") if own else len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(place)]
            names = [*kept.names[:-1], "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(scores, pa.float64())], names=names)

    kept = kept.add("score", "double")
    return frame.mapInArrow(run, kept)


def in_training(doc_id: Column) -> Column:
    """The fold that labels may be learnt from."""
    return crc_bucket(doc_id, 3) != 1


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, in_training(F.col("doc_id")))
    return score(docs, model, "doc_id").select(
        "doc_id",
        (~in_training(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )

"""Exact dedup: sorted digest runs merged up a tree of partitions.

Every input partition turns its texts into a run of records (digest, check, code
points, doc_id, copies) sorted by digest. In each of log_F(P) rounds a node takes
its share of the digest range from F partner runs, merges them and keeps one
record per digest: the best survivor so far and the sum of copies. A round
narrows the range of a node as it widens its sources, so nodes stay the same
size, and a text that fills a third of the table enters a node at most F times.

Two records merge only if SHA-256, xxHash64 and length of the normalised text all
agree, so a digest that collides would stay apart.

Defined results: NULL text is empty; texts of white space only are equal to it;
ties keep the smallest doc_id; NULL doc_id sorts last; repeated rows are copies
of each other, and those that carry the surviving doc_id all count as kept;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtscope.llm.common import SPACE_BYTES, materialise

FAN = 8
#: Records that one node of the tree should hold at most; sets the number of nodes.
NODE_RECORDS = 1_000_000
#: Stands for a NULL doc_id in records: larger than any other.
_NULL_ID = np.iinfo(np.int64).max

_LEAF = "doc_id long, text_sha256 binary, text_check long, n_points long, n_bytes long"
_RUN = "source long, span long, run binary"
_RECORD = np.dtype(
    [("digest", ">u8", (4,)), ("check", "<i8"), ("bytes", "<i8"), ("points", "<i8"), ("id", "<i8"), ("copies", "<i8")]
)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, checks, points, sizes = [], [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            body = text.encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)
            digests.append(hashlib.sha256(body).digest())
            checks.append(xxhash.xxh64_intdigest(body) - (1 << 63))
            points.append(len(text))
            sizes.append(len(body))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(checks, pa.int64()),
                pa.array(points, pa.int64()),
                pa.array(sizes, pa.int64()),
            ],
            names=["doc_id", "text_sha256", "text_check", "n_points", "n_bytes"],
        )


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, text_check, n_points, n_bytes) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digest_batches, _LEAF)


def merge_records(records: np.ndarray) -> np.ndarray:
    """Sort by digest, keep one record for equal ones: most code points, then
    smallest id; copies add up."""
    if not len(records):
        return records
    d = records["digest"]
    order = np.lexsort(
        (records["id"], -records["points"], records["bytes"], records["check"], d[:, 3], d[:, 2], d[:, 1], d[:, 0])
    )
    r = records[order]
    first = np.ones(len(r), bool)
    first[1:] = (
        (r["digest"][1:] != r["digest"][:-1]).any(axis=1)
        | (r["check"][1:] != r["check"][:-1])
        | (r["bytes"][1:] != r["bytes"][:-1])
    )
    starts = np.flatnonzero(first)
    kept = r[starts]
    kept["copies"] = np.add.reduceat(r["copies"], starts)
    return kept


def _digit(records: np.ndarray, level: int, levels: int) -> np.ndarray:
    """The level-th base-FAN digit of the digest's place among FAN**levels spans."""
    place = records["digest"][:, 0].astype(np.uint64) >> np.uint64(64 - 3 * levels)
    return (place // np.uint64(FAN ** (levels - 1 - level))) % np.uint64(FAN)


def _leaf_runs(levels: int):
    nodes = FAN**levels

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = TaskContext.get().partitionId() % nodes
        for batch in batches:  # a run for each batch: tasks hold one batch at a time
            n = batch.num_rows
            if not n:
                continue
            rec = np.zeros(n, _RECORD)
            rec["digest"] = np.frombuffer(b"".join(batch.column("text_sha256").to_pylist()), ">u8").reshape(n, 4)
            rec["check"] = batch.column("text_check").to_numpy(zero_copy_only=False)
            rec["bytes"] = batch.column("n_bytes").to_numpy(zero_copy_only=False)
            rec["points"] = batch.column("n_points").to_numpy(zero_copy_only=False)
            rec["id"] = batch.column("doc_id").fill_null(int(_NULL_ID)).to_numpy(zero_copy_only=False)
            rec["copies"] = 1
            yield _sliced(merge_records(rec), source, 0, 0, levels)

    return build


def _sliced(records: np.ndarray, source: int, span: int, level: int, levels: int) -> pa.RecordBatch:
    """A run cut into the FAN parts that go to the nodes of the next round."""
    digit = _digit(records, level, levels)
    out = [(source // FAN, span * FAN + k, records[digit == k].tobytes()) for k in range(FAN)]
    out = [x for x in out if x[2]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in out], pa.int64()),
            pa.array([x[1] for x in out], pa.int64()),
            pa.array([x[2] for x in out], pa.binary()),
        ],
        names=["source", "span", "run"],
    )


def _merged(table: pa.Table) -> np.ndarray:
    """One run of all; concatenate makes digests little-endian, runs keep them big-endian."""
    runs = [np.frombuffer(r.as_buffer(), _RECORD) for r in table.column("run")]
    return merge_records(np.concatenate(runs).astype(_RECORD, copy=False))


def _round(level: int, levels: int):
    def merge(table: pa.Table) -> pa.Table:
        source, span = table.column("source")[0].as_py(), table.column("span")[0].as_py()
        return pa.Table.from_batches([_sliced(_merged(table), source, span, level, levels)])

    return merge


def _root(table: pa.Table) -> pa.Table:
    best = _merged(table)
    best = best[best["copies"] > 1]
    raw = best["digest"].astype(">u8").tobytes()
    ids = best["id"].astype(np.int64)
    return pa.table(
        {
            "text_sha256": pa.array([raw[32 * k : 32 * k + 32] for k in range(len(best))], pa.binary()),
            "text_check": pa.array(best["check"].astype(np.int64)),
            "n_bytes": pa.array(best["bytes"].astype(np.int64)),
            "keep_id": pa.array(ids, mask=ids == _NULL_ID),
            "keep_points": pa.array(best["points"].astype(np.int64)),
            "group_size": pa.array(best["copies"].astype(np.int64)),
        }
    )


def survivors(leaf: DataFrame, node_records: int = NODE_RECORDS) -> DataFrame:
    """Key, keep_id, keep_points and group_size of every text with copies."""
    spark = leaf.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(leaf.count() / node_records))
    levels = max(1, math.ceil(math.log(max(parts, 2), FAN)))
    runs = leaf.mapInArrow(_leaf_runs(levels), _RUN)
    for level in range(1, levels):
        runs = runs.groupBy("source", "span").applyInArrow(_round(level, levels), _RUN)
    return runs.groupBy("source", "span").applyInArrow(
        _root, "text_sha256 binary, text_check long, n_bytes long, keep_id long, keep_points long, group_size long"
    )


def exact_dedup(docs: DataFrame, node_records: int = NODE_RECORDS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    leaf = materialise(digests(docs), "exact-dedup-leaf")
    best = survivors(leaf, node_records)
    key = ["text_sha256", "text_check", "n_bytes"]
    joined = leaf.join(best, key, "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(
            grouped, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
        )
        .otherwise(F.lit(True))
        .alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
        "n_points",
    )

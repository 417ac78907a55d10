"""Ranked lexical search of whole documents by bag deduplication.

Documents are cut down to the vocabulary of the items that ask. What is left of a
document is its bag: the item terms it holds, how often each occurs, and its length
figure ``m``. Documents with one bag have one score for every item, so they form a
class: classes are routed by a 64-bit hash of the bag and told apart by the bag
itself, each class is scored once, and only the classes that lead for some item are
expanded to their documents, by ascending doc_id.

Steps: one pass over the texts writes the bags; a grouping makes the classes; the
document frequencies are sums over classes; tasks score blocks of classes against
all items of a block and keep ``k`` classes for each item; the leaders of all tasks
are ranked; members of the leading classes are read from the bags and ranked again.
A class that comes after ``k`` others by (score, smallest doc_id) has no member
among the first ``k`` documents, so keeping ``k`` classes loses nothing, and for the
same reason a class needs no more than its ``k`` smallest members.

Only what belongs to one block of items (``BLOCK_ITEMS``, ``BLOCK_BYTES``) is sent to
the tasks: its vocabulary, postings and weights. More items take more passes.

Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z
lower-cased. With N documents that have a term, L their terms, n the terms of one
document, df the documents with a term and tf its occurrences in a document:
weight = floor(1000 * ln((2N + 2) / (2df + 1))), m = 50 + (50 * n * N) div L, score =
sum of weight * ((10**9 * tf) div (1000 * tf + 20 * m)) over an item's distinct terms.

Defined results: NULL and empty texts have no terms, are in no result and not in N;
an item without terms, or whose terms no document holds, has no rows; scores of 0 are
left out; rows that repeat a doc_id are documents of their own, NULL ids come last
among equal scores; equal rows of items are one item, rows that share an item_id but
not the text are ranked apart; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surtscope.llm.common import materialise
from surtscope.operators.rollups import top_k

#: Documents returned for each item.
TOP = 50
#: Items of one pass, and about the bytes of their texts.
BLOCK_ITEMS = 4096
BLOCK_BYTES = 2 << 20
#: Scores that a task holds at a time.
_CELLS = 1 << 20
_LAST = np.iinfo(np.int64).max

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TERM_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEPT else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of the rows with a term: ``n`` counts all terms, the
    arrays hold the vocabulary's ids in ascending order and their occurrences."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = known.value
        for batch in batches:
            lengths, sizes, ids, counts = [], [0], [], []
            for text in batch.column("body"):
                words = terms(text.as_py())
                found = sorted((ids_of[w], c) for w, c in Counter(words).items() if w in ids_of)
                lengths.append(len(words))
                ids.extend(i for i, _ in found)
                counts.extend(c for _, c in found)
                sizes.append(len(ids))
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                ],
                names=["doc_id", "n", "terms", "counts"],
            ).filter(pa.array([n > 0 for n in lengths], pa.bool_()))

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    schema = "doc_id long, n long, terms array<int>, counts array<int>"
    return docs.select(F.col("doc_id").cast("long"), body).mapInArrow(run, schema)


def _length_figure(n_docs: int, n_terms: int) -> Column:
    """``m``; the product may pass 64 bits, so it is taken in decimals."""
    exact = "CAST({} AS DECIMAL(19, 0))".format
    return F.expr(f"50 + ({exact('50 * n')} * {exact(n_docs)}) DIV {exact(n_terms)}")


def _keyed(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Bags with ``m`` and the hash that routes their class."""
    with_m = found.where(F.size("terms") > 0).withColumn("m", _length_figure(n_docs, n_terms))
    return with_m.withColumn("hash", F.xxhash64("m", "terms", "counts"))


_BAG = ["hash", "m", "terms", "counts"]


def classes_of(keyed: DataFrame) -> DataFrame:
    """One row for each distinct bag: its key, its smallest doc_id and its size."""
    grouped = keyed.groupBy(*_BAG).agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("members")
    )
    return grouped.withColumn("class_id", F.monotonically_increasing_id())


class _Leaders:
    """The first ``k`` classes of each item that a task has seen."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self._kept = [np.zeros(0, np.int64)] * 4  # item, score, first_id, class_id

    def add(self, scores: np.ndarray, first: np.ndarray, class_id: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        new = (item, scores[row, item], first[row], class_id[row])
        item, score, first, class_id = (np.concatenate(p) for p in zip(self._kept, new))
        order = np.lexsort((class_id, first, -score, item))
        item = item[order]
        starts = np.searchsorted(item, item, side="left")
        place = np.arange(len(item)) - starts
        stay = place < self.k
        order = order[stay]
        self._kept = [item[stay], score[order], first[order], class_id[order]]
        full = place[stay] == self.k - 1
        self.floor[self._kept[0][full]] = self._kept[1][full]

    def batch(self) -> pa.RecordBatch:
        item, score, first, class_id = self._kept
        arrays = [
            pa.array(item.astype(np.int32)),
            pa.array(class_id),
            pa.array(score),
            pa.array(first, mask=first == _LAST),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["item", "class_id", "score", "first_id"])


def _leaders(classes: DataFrame, postings: list[np.ndarray], weights: np.ndarray, n_items: int, k: int) -> DataFrame:
    """(item, class_id, score, first_id): for each task and item its first ``k`` classes."""
    shared = classes.sparkSession.sparkContext.broadcast((postings, weights))
    step = max(1, _CELLS // n_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_of, weight_of = shared.value
        best = _Leaders(n_items, k)
        for batch in batches:
            for part in (batch.slice(s, step) for s in range(0, batch.num_rows, step)):
                ids = part.column("terms").flatten().to_numpy()
                tf = part.column("counts").flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), part.column("terms").value_lengths().to_numpy())
                m = part.column("m").to_numpy()[row]
                share = (10**9 * tf) // (1000 * tf + 20 * m) * weight_of[ids]
                order = np.argsort(ids, kind="stable")
                ids, row, share = ids[order], row[order], share[order]
                ends = np.flatnonzero(np.diff(ids, append=-1)) + 1
                scores = np.zeros((part.num_rows, n_items), np.int64)
                for start, end in zip(np.concatenate([[0], ends[:-1]]), ends):
                    asking = items_of[ids[start]]
                    scores[row[start:end, None], asking] += share[start:end, None]
                first = part.column("first_id").fill_null(_LAST).to_numpy()
                best.add(scores, first, part.column("class_id").to_numpy())
        yield best.batch()

    columns = classes.select("class_id", "first_id", "m", "terms", "counts")
    return columns.mapInArrow(run, "item int, class_id long, score long, first_id long")


def _postings(items: list[set[bytes]]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """Ids of the items' terms, and for each id the items that ask for it."""
    vocabulary: dict[bytes, int] = {}
    asking: list[list[int]] = []
    for k, words in enumerate(items):
        for word in sorted(words):
            if word not in vocabulary:
                vocabulary[word] = len(asking)
                asking.append([])
            asking[vocabulary[word]].append(k)
    return vocabulary, [np.array(a) for a in asking]


def _search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    """Results of one block of items; None if it can have none."""
    spark = docs.sparkSession
    asked = block.toArrow()
    vocabulary, postings = _postings([set(terms((t.as_py() or "").encode())) for t in asked.column("text")])
    if not vocabulary:
        return None
    found = materialise(bags(docs, vocabulary), "search-bags")
    totals = found.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not totals.docs:
        return None
    keyed = _keyed(found, totals.docs, totals.terms)
    classes = materialise(classes_of(keyed), "search-classes")

    held = classes.select(F.explode("terms").alias("term"), "members").groupBy("term").agg(F.sum("members").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for row in held.collect():  # at most the vocabulary of one block
        weights[row.term] = weight(totals.docs, row.df)

    order = [F.col("score").desc(), F.col("first_id").asc_nulls_last(), F.col("class_id")]
    of_tasks = _leaders(classes, postings, weights, asked.num_rows, k)
    leaders = materialise(top_k(of_tasks, k, order, ["item"]), "search-leaders")

    leading = leaders.select("class_id").distinct().join(classes.select("class_id", *_BAG), "class_id")
    # the narrow hash first, so that only rows of leading classes carry their bags on
    members = keyed.join(leading.select("hash").distinct(), "hash", "left_semi").join(leading, _BAG)
    by_id = [F.col("doc_id").asc_nulls_last()]
    members = top_k(members.select("class_id", "doc_id"), k, by_id, ["class_id"])

    scored = leaders.select("item", "class_id", "score").join(members, "class_id")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), *by_id))
    ranked = scored.withColumn("rank", place).where(F.col("rank") <= k)
    number = pa.array(range(asked.num_rows), pa.int32())
    names = spark.createDataFrame(pa.table({"item": number, "item_id": asked.column("item_id")}))
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the first ``k`` of all ``docs`` for each row of ``items``."""
    spark = docs.sparkSession
    asked = items.select("item_id", "text").distinct()
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, math.ceil(size.n / block_items), math.ceil((size.bytes or 0) / block_bytes))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    results = [_search_block(docs, asked.where(place == b), k) for b in range(blocks)]
    results = [r for r in results if r is not None]
    if not results:
        item_type = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)

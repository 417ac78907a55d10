"""Groups of texts that share most of their word shingles, verified pair by pair.

Two texts are near copies if the sets of their five-word shingles (lower-cased
words; a text of fewer words is one shingle) have a Jaccard similarity of 0.8 or
more. Pairs to verify come from two searches:

* the Golay search of ``simhash`` on fingerprints of the same shingles: texts whose
  fingerprints are connected by steps of three bits form a cell. It finds copies and
  close variants at the cost of one pair for each text;
* a prefix filter, which misses no pair. All shingles have one global order, rare ones
  first. If two texts are similar, then a shingle they share stands among the first
  ``n - ceil(2s / (1 + s) * n) + 1`` of the n shingles of the one with fewer, and among
  the first ``n - ceil(s * n) + 1`` of the other. Texts with such a shingle form a cell;
  number and place of shingles rule out most pairs of a cell without a look at the texts.

Any order would do for exactness. The order here is by approximate frequency, from a
table of ``2**BUCKET_BITS`` counters that all shingles of all texts are counted into, so
that a shingle of a common line is no key unless a text has little else.

A large group of copies must not cost all its pairs: in ``ROUNDS`` rounds each cell's
most central text (whose shingles are the most frequent on average) is compared with the
texts of other groups in the cell, and groups that prove similar become one. Only then
are the pairs formed that lie in different groups of a cell and may still be similar.

Defined results: NULL and empty texts, and texts of white space only, are one empty
shingle and near copies of each other. Hashes only propose pairs: whether two texts are
near copies is decided on their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtscope.llm.common import materialise, text_or_empty
from surtscope.llm.components import components
from surtscope.llm.simhash import fingerprints, links

SHINGLE = 5
SIMILARITY = 0.8
#: Counters of approximate frequency; they make the order, not the result.
BUCKET_BITS = 22
#: Rounds in which a cell's central text is compared with the others.
ROUNDS = 2
_BLOCK_BITS = 16
_SUMMING = 16
#: Shingle sets, and hashes of words, that a task remembers.
_HELD = 256
_WORDS = 500_000
#: Room for rounding, on the side that lets pairs pass.
_SLACK = 1e-6

_MIX = np.uint64(0xD6E8FEB86659FD93)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str, width: int = SHINGLE) -> set[bytes]:
    words = _words(text)
    if len(words) < width:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[k:] for k in range(width)))))


class ShingleHasher:
    """64-bit hashes of the distinct shingles of texts; remembers the hashes of words."""

    def __init__(self, width: int):
        self._width, self._known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        words = _words(text)
        if len(words) < self._width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
        known = self._known
        if len(known) > _WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.array([known[w] for w in words], np.uint64)
        count = len(words) - self._width + 1
        mixed = np.zeros(count, np.uint64)
        for k in range(self._width):
            mixed = (mixed ^ hashes[k : k + count]) * _MIX
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def frequency_levels(texts: DataFrame, width: int = SHINGLE) -> np.ndarray:
    """About eight times the binary logarithm of each counter, a byte each.

    Tasks count into an array of their own and send it in blocks, which are summed
    where they meet; the result has one size for any corpus.
    """
    size, block = 1 << BUCKET_BITS, 1 << _BLOCK_BITS
    names = ["block", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counters = ShingleHasher(width), np.zeros(size, np.int64)
        for batch in batches:
            found = [hasher(t.as_py()) for t in batch.column("text")]
            if found:
                counters += np.bincount(_bucket(np.concatenate(found)), minlength=size)
        # a counter that is full keeps its place at the end of the order
        parts = np.minimum(counters, np.iinfo(np.uint16).max).astype(np.uint16).reshape(-1, block)
        for k, part in enumerate(parts):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("block").to_pylist(), batch.column("counts")):
                known = sums.setdefault(k, np.zeros(block, np.int64))
                known += np.frombuffer(part.as_buffer(), np.uint16)
        for k, found in sums.items():
            level = np.minimum(8 * np.log2(found + 1), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()])], names=names)

    parts = texts.select("text").mapInArrow(count, "block int, counts binary")
    summed = parts.repartition(_SUMMING, "block").mapInArrow(total, "block int, counts binary")
    levels = np.zeros(size, np.uint8)
    for row in summed.collect():  # 2**BUCKET_BITS bytes in all
        levels[row.block * block : (row.block + 1) * block] = np.frombuffer(row.counts, np.uint8)
    return levels


def prefix_sizes(n: int, similarity: float) -> tuple[int, int]:
    """How many shingles of n must be looked at beside a text of as many or more, and
    beside one of as many or fewer."""
    short = n - math.ceil(2 * similarity / (1 + similarity) * n - _SLACK) + 1
    return short, max(short, n - math.ceil(similarity * n - _SLACK) + 1)


def _prefixes(texts: DataFrame, levels: np.ndarray, width: int, similarity: float) -> DataFrame:
    """(node, n, short, central, keys): the rarest shingles of each text, in order."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, level_of = ShingleHasher(width), shared.value
        for batch in batches:
            sizes, shorts, central, keys = [], [], [], []
            for text in batch.column("text"):
                hashes = hasher(text.as_py())
                level = level_of[_bucket(hashes)]
                short, long = prefix_sizes(len(hashes), similarity)
                keys.append(hashes[np.lexsort((hashes, level))[:long]])
                sizes.append(len(hashes))
                shorts.append(short)
                central.append(float(level.mean()))
            offsets = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            values = pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64))
            columns = [pa.array(sizes, pa.int32()), pa.array(shorts, pa.int32()), pa.array(central, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), *columns, pa.ListArray.from_arrays(offsets, values)],
                names=["node", "n", "short", "central", "keys"],
            )

    schema = "node long, n int, short int, central double, keys array<long>"
    return texts.select("node", "text").mapInArrow(run, schema)


def _similar(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[bytes]] = {}

        def of(node: int, text: pa.Scalar) -> set[bytes]:
            if node not in held:
                if len(held) >= _HELD:
                    held.clear()
                held[node] = shingles(text.as_py(), width)
            return held[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            near = []
            for x, y, text_x, text_y in zip(a, b, batch.column("text_a"), batch.column("text_b")):
                one, two = of(x, text_x), of(y, text_y)
                both = len(one & two)
                near.append(both / (len(one) + len(two) - both) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _possible(x: str, y: str, similarity: float) -> Column:
    """Whether texts that share a shingle at their places may be similar, if it is the
    first they share; x has fewer shingles, or as many and the smaller number."""
    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    needed = F.ceil(F.lit(similarity / (1 + similarity)) * (of(x, "n") + of(y, "n")) - F.lit(_SLACK))
    rest = F.least(of(x, "n") - of(x, "place"), of(y, "n") - of(y, "place"))
    first = (of(x, "n") < of(y, "n")) | ((of(x, "n") == of(y, "n")) & (of(x, "node") < of(y, "node")))
    return first & (of(x, "place") < of(x, "short")) & (rest >= needed)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")]


class _Search:
    """Pairs that were compared, and the groups that those found close make."""

    def __init__(self, texts: DataFrame, width: int, similarity: float):
        self._texts, self._width, self.similarity = texts, width, similarity
        self.tested = texts.sparkSession.createDataFrame([], "a long, b long")
        self.groups = texts.sparkSession.createDataFrame([], "node long, root long")

    def compare(self, pairs: DataFrame, label: str) -> None:
        """Verify the pairs that are new, and join the groups of close ones."""
        fresh = materialise(pairs.distinct().join(self.tested, ["a", "b"], "left_anti"), f"near-{label}-pairs")
        if fresh.isEmpty():
            return
        self.tested = self.tested.union(fresh)
        close = materialise(_similar(fresh, self._texts, self._width, self.similarity), f"near-{label}")
        if close.isEmpty():
            return
        # groups so far as edges to their roots, so that roots move together
        known = self.groups.where("node <> root").select(F.col("node").alias("b"), F.col("root").alias("a"))
        self.groups = components(close.unionByName(known))

    def mixed(self, cells: DataFrame) -> DataFrame:
        """Cells whose texts lie in several groups, with the group of each text."""
        rows = cells.join(self.groups, "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root")
        ends = rows.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most"))
        several = ends.where("least < most").select("key")
        return materialise(rows.join(several, "key", "left_semi"), "near-mixed")


def _central(rows: DataFrame) -> DataFrame:
    """(key, node, group, n, place, short) of each cell's central text."""
    row = F.struct("node", "group", "n", "place", "short")
    best = rows.groupBy("key").agg(F.max_by(row, F.struct("central", F.negative("node"))).alias("best"))
    return best.select("key", "best.*")


def _stars(mixed: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a cell's central text, and of the most central one outside its group, with
    the texts of other groups."""
    first = _central(mixed)
    others = mixed.join(first.select("key", F.col("group").alias("taken")), "key").where("group <> taken").drop("taken")
    centres = first.union(_central(others))
    joined = mixed.alias("m").join(centres.alias("c"), "key").where("m.group <> c.group")
    near = _possible("m", "c", similarity) | _possible("c", "m", similarity)
    return joined.where(near).select(*_ordered("m", "c"))


def _crossing(mixed: DataFrame, similarity: float) -> DataFrame:
    """All pairs of different groups of a cell that may be similar."""
    joined = mixed.alias("x").join(mixed.alias("y"), "key").where("x.group <> y.group")
    return joined.where(_possible("x", "y", similarity)).select(*_ordered("x", "y"))


def _prefix_cells(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(key, node, n, place, short, central) of shingles that may bring texts together."""
    prefixes = materialise(_prefixes(texts, frequency_levels(texts, width), width, similarity), "near-prefixes")
    keyed = prefixes.select("node", "short", F.posexplode("keys").alias("place", "key"))
    shared = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("place") < F.col("short")).alias("firsts")
    )
    live = shared.where("texts > 1 AND firsts > 0").select("key")
    cells = keyed.drop("short").join(live, "key")
    return materialise(cells.join(prefixes.drop("keys"), "node"), "near-cells")


def _golay_cells(texts: DataFrame, width: int) -> DataFrame:
    """Texts with connected fingerprints; each may be compared with each."""
    prints = materialise(fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), width), "near-prints")
    roots = components(links(prints.select("fp").distinct()))
    cells = prints.join(roots, prints.fp == roots.node, "left").select(
        F.coalesce("root", "fp").alias("key"), F.col("doc_id").alias("node")
    )
    crowded = cells.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key")
    return materialise(cells.join(crowded, "key"), "near-golay")


def near_texts(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row; a component is named by its least doc_id."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("node"), F.col("doc_id").cast("long"), text_or_empty().alias("text")
    )
    rows = materialise(rows, "near-rows")
    golay = _golay_cells(rows, width)
    cells = _prefix_cells(rows, width, similarity)
    wanted = golay.select("node").union(cells.select("node")).distinct()
    texts = materialise(rows.select("node", "text").join(wanted, "node", "left_semi"), "near-texts")

    search = _Search(texts, width, similarity)
    least = golay.groupBy("key").agg(F.min("node").alias("first"))
    stars = golay.join(least, "key").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    search.compare(stars, "golay")
    rest = search.mixed(cells)
    for k in range(ROUNDS):
        if rest.isEmpty():
            break
        search.compare(_stars(rest, similarity), f"stars{k}")
        rest = search.mixed(rest.drop("group"))
    search.compare(_crossing(rest, similarity), "crossing")

    placed = rows.select("doc_id", "node").join(search.groups, "node", "left")
    placed = placed.select("doc_id", F.coalesce("root", "node").alias("root"))
    names = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(names, "root").select("doc_id", "component_id")

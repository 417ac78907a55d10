"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each read as a 23-bit word of
the perfect Golay code (short ones padded with zeros). Of two fingerprints that
differ in at most three bits, at least two of the three segments differ in at most
one bit each (pigeonhole). A segment is decoded to the index of its nearest
codeword; a word three errors away from it also gets the indices of those
codewords four errors away that are smaller. Two words one bit apart then share
an index: their nearest codewords are equal, or each is four errors away from the
other's, and both words carry the smaller one. A key joins the indices of two
segments. Fingerprints meet under equal keys and are verified bit by bit.

A key that more than ``CELL`` different fingerprints share is not searched in one
task. Its fingerprints get wider keys: 16 blocks of four bits less any three
blocks, one of which two fingerprints at most three bits apart always share. Such
a key leaves 12 bits open, so it is met by 4096 fingerprints at most. Inside a
cell a spanning forest of links is kept: components stay the same and no group
yields all its pairs.

Defined results: NULL and empty texts, and texts of white space only, have
fingerprint zero and link like any other; repeated rows share their component;
a NULL doc_id never names a component unless all its members are NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtscope.llm.common import materialise
from surtscope.llm.components import components

SEED = 42
MAX_BITS = 3
#: Fingerprints under one key that a task compares; more get wider keys.
CELL = 4096
#: Cells up to this size yield all their links, larger ones a spanning forest.
_SMALL = 8
#: (shift, bits) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
_CHECK_BITS = 11

_ROW = "doc_id long, fp long"


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=">u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_signed(found))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROW)


class Golay:
    """Decoding tables of the (23, 12) code, made from its generator."""

    def __init__(self) -> None:
        word = np.arange(1 << 12, dtype=np.int64) << _CHECK_BITS
        rest = word.copy()
        for bit in range(22, _CHECK_BITS - 1, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - _CHECK_BITS)), rest)
        self.remainder = rest
        self.error = np.zeros(1 << _CHECK_BITS, np.int64)
        self.weight = np.zeros(1 << _CHECK_BITS, np.int64)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                s = int(self.syndrome(np.array([e]))[0])
                self.error[s], self.weight[s] = e, weight
        four: dict[int, list[int]] = {}
        for bits in combinations(range(23), 4):
            e = sum(1 << b for b in bits)
            four.setdefault(int(self.syndrome(np.array([e]))[0]), []).append(e)
        self.four = np.zeros((1 << _CHECK_BITS, 5), np.int64)
        for s, errors in four.items():
            self.four[s] = errors

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.remainder[words >> _CHECK_BITS] ^ (words & ((1 << _CHECK_BITS) - 1))

    def indices(self, words: np.ndarray) -> np.ndarray:
        """Six columns of codeword indices for each word, -1 where there is none."""
        s = self.syndrome(words)
        near = (words ^ self.error[s]) >> _CHECK_BITS
        more = (words[:, None] ^ self.four[s]) >> _CHECK_BITS
        use = (self.weight[s] == 3)[:, None] & (more < near[:, None])
        return np.concatenate([near[:, None], np.where(use, more, -1)], axis=1)


_golay: Golay | None = None


def _code() -> Golay:
    global _golay
    if _golay is None:
        _golay = Golay()
    return _golay


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of all Golay keys of unsigned fingerprints."""
    code = _code()
    index = [code.indices(((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64)) for s, n in SEGMENTS]
    at, keys = [], []
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        a = np.repeat(index[i], 6, axis=1)
        b = np.tile(index[j], (1, 6))
        rows, columns = np.nonzero((a >= 0) & (b >= 0))
        at.append(rows)
        keys.append(pair << 24 | a[rows, columns] << 12 | b[rows, columns])
    return np.concatenate(at), np.concatenate(keys)


_WIDE_MASKS = np.array(
    [(1 << 64) - 1 - sum(0xF << (4 * b) for b in blocks) for blocks in combinations(range(16), MAX_BITS)], np.uint64
)


def _wide_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): 560 keys that leave 12 bits open each."""
    kept = fps[:, None] & _WIDE_MASKS[None, :]
    mixed = (kept ^ (np.arange(len(_WIDE_MASKS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]) * np.uint64(
        0xD6E8FEB86659FD93
    )
    return np.repeat(np.arange(len(fps)), len(_WIDE_MASKS)), mixed.ravel().view(np.int64)


def _keyed(frame: DataFrame, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                fps = batch.column("fp").slice(k, 1000).to_numpy(zero_copy_only=False)
                at, keys = make(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(fps[at])], names=["key", "fp"])

    return frame.select("fp").mapInArrow(run, "key long, fp long")


def _forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span each component of a cell."""
    rest, stack, out = fps[1:], [fps[0]], []
    while True:
        if not stack:
            if not len(rest):
                return out
            stack, rest = [rest[0]], rest[1:]
        x = stack.pop()
        near = np.bitwise_count(rest ^ x) <= MAX_BITS
        if near.any():
            new = rest[near]
            out.append((np.full(len(new), x), new))
            rest = rest[~near]
            stack.extend(new)


def cell_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside cells; rows are sorted by key."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    for start, n in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL]):
        out += _forest(fps[start : start + n])
    small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
    k, f = keys[small], fps[small]
    for lag in range(1, _SMALL):
        a, b = f[:-lag], f[lag:]
        hit = (k[:-lag] == k[lag:]) & (np.bitwise_count(a ^ b) <= MAX_BITS)
        out.append((a[hit], b[hit]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _linked(keyed: DataFrame, cell: int) -> DataFrame:
    """(a, b) links, and (fp, NULL) for the members of cells beyond ``cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def emit(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            second = pa.array(b.view(np.int64)) if b is not None else pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second], names=["a", "b"])

        for batch in batches:
            keys = np.r_[held_k, batch.column("key").to_numpy(zero_copy_only=False)]
            fps = np.r_[held_f, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(keys):
                continue
            if hot is not None:  # the rest of a large cell
                n = int(np.searchsorted(keys != hot, True))
                if n:
                    yield emit(fps[:n], None)
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    held_k, held_f = keys, fps
                    continue
                hot = None
            last = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
            if len(keys) - last > cell:
                hot = keys[-1]
                yield emit(fps[last:], None)
                held_k, held_f = keys[:0], fps[:0]
            else:
                held_k, held_f = keys[last:], fps[last:]
            keys, fps = keys[:last], fps[:last]
            sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]) if len(keys) else keys
            large = np.repeat(sizes > cell, sizes) if len(keys) else np.zeros(0, bool)
            if large.any():
                yield emit(fps[large], None)
            yield emit(*cell_links(keys[~large], fps[~large]))
        if len(held_k):
            yield emit(*cell_links(held_k, held_f))

    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def links(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect all different fingerprints within three bits."""
    found = materialise(_linked(_keyed(fps, fuzzy_keys), cell).distinct(), "simhash-links")
    close = found.where("b is not null")
    crowded = found.where("b is null").select(F.col("a").alias("fp"))
    if crowded.isEmpty():
        return close
    return close.union(_linked(_keyed(crowded, _wide_keys), 1 << 62))


def near_groups(docs: DataFrame, shingle: int = 3, cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = materialise(fingerprints(docs, shingle), "simhash-rows")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes, cell))
    placed = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = placed.join(least, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

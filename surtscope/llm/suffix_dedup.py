"""Removal of repeated passages with a distributed suffix sort.

Every byte that lies in a ``LENGTH``-byte string which also starts in a document
with a smaller id is removed. All strings of all texts are covered:

1. Equal texts are found by SHA-256; only the row with the smallest id takes part,
   as the others lose every byte (if they have ``LENGTH`` bytes at all).
2. Documents are dealt into blocks of about ``BLOCK_BYTES`` by a hash of id and
   text. A block hashes all its 16-byte grams; the smallest hash among the grams
   of a string is the string's anchor. Equal strings have equal anchors, so a
   string can repeat only if its anchor is found in two documents.
3. Anchors meet by hash, once for each block. Anchors of two documents go back to
   their blocks, which send the bytes around them: a run of strings with the same
   anchor, once for each block, with the smallest and the largest id it has there.
4. The runs of an anchor are sorted, string by string, by deep-shallow suffix
   sorting (``deep_shallow``); equal neighbours share the smallest id among them.
   Runs that are equal as a whole are sorted once.
5. Blocks get the smallest ids back and remove what smaller ids cover.

No step holds more than a block, or what blocks send about one bucket of anchors.
A passage that a third of all documents share is sent once for each block.

Defined results: NULL text is empty; texts shorter than ``LENGTH`` lose nothing;
a NULL doc_id counts as larger than any other; rows with the same doc_id never
remove each other's bytes; repeated rows repeat their result; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtscope.llm.common import total_bytes
from surtscope.llm.deep_shallow import sort_prefixes

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 4 << 20
_CHUNK = 1 << 20
_NO_ID = (1 << 63) - 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIXER = np.uint64(0xD6E8FEB86659FD93)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed hash of the GRAM bytes from each position."""
    h = data.astype(np.uint64) + np.uint64(1)
    power, span = _MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while span < GRAM:
            h = h[:-span] * power + h[span:]
            power, span = power * power, 2 * span
        h ^= h >> np.uint64(29)
        h *= _MIXER
        h ^= h >> np.uint64(32)
        h *= _MULTIPLIER
    return h


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def anchor_runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, end, anchor, document) of the runs of strings with one anchor.

    ``starts`` has the first byte of each document and the end of the last.
    """
    ends = starts[1:]
    whole = np.flatnonzero(ends - starts[:-1] >= LENGTH)
    n = len(data) - LENGTH + 1
    empty = np.zeros(0, np.int64)
    if n <= 0 or not len(whole):
        return empty, empty, empty.astype(np.uint64), empty
    first = np.sort(np.r_[starts[:-1][whole], ends[whole] - LENGTH + 1])
    at, keys, before = [], [], None
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        m = _window_minima(_gram_hashes(data[lo : hi + LENGTH - 1]), LENGTH - GRAM + 1) & ~np.uint64(1)
        change = np.empty(hi - lo, bool)
        change[0] = before is None or m[0] != before
        change[1:] = m[1:] != m[:-1]
        inside = first[(first >= lo) & (first < hi)] - lo
        change[inside] = True
        found = np.flatnonzero(change)
        at.append(found + lo)
        keys.append(m[found])
        before = m[-1]
    begin, key = np.concatenate(at), np.concatenate(keys)
    stop = np.r_[begin[1:], n]
    document = np.searchsorted(starts, begin, "right") - 1
    document = np.minimum(document, len(ends) - 1)
    real = begin + LENGTH <= ends[document]
    return begin[real], stop[real], key[real], document[real]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * _MULTIPLIER) >> np.uint64(32)) % np.uint64(buckets)


class _Block:
    """The documents of a block: those that take part, and their runs."""

    def __init__(self, rows: pa.Table, side: pa.Table):
        self.ids = rows.column("doc_id").fill_null(_NO_ID).to_numpy()
        self.texts = rows.column("text").cast(pa.binary()).to_pylist()
        self.shas = rows.column("sha").to_pylist()
        heads = set(zip(side.column("head").to_pylist(), side.column("head_sha").to_pylist()))
        pairs = list(zip(self.ids.tolist(), self.shas))
        # every pass must number runs alike, in whatever order rows arrive
        self.heads = sorted((k for k, pair in enumerate(pairs) if pair in heads), key=pairs.__getitem__)
        self.raw = b"".join(self.texts[k] for k in self.heads)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.starts = np.cumsum([0, *(len(self.texts[k]) for k in self.heads)]).astype(np.int64)
        self.head_ids = self.ids[self.heads]
        self.begin, self.stop, self.key, self.document = anchor_runs(self.data, self.starts)

    def run_bytes(self, k: int) -> bytes:
        return self.raw[self.begin[k] : self.stop[k] - 1 + LENGTH]


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype)


def _anchors(buckets: int):
    """Anchors of a block by bucket; the low bit says that two documents have it."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        block = _Block(rows, side)
        out = {"bucket": [], "block": [], "keys": []}
        if len(block.key):
            order = np.argsort(block.key, kind="stable")
            keys, docs = block.key[order], block.document[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            many = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
            _by_bucket(out, keys[first] | many.astype(np.uint64), _bucket(keys[first], buckets), rows.column("block")[0].as_py())
        return pa.table([pa.array(out["bucket"], pa.int64()), pa.array(out["block"], pa.int64()), pa.array(out["keys"], pa.binary())], names=list(out))

    return run


def _by_bucket(out: dict, values: np.ndarray, bucket: np.ndarray, block: int) -> None:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(order)]):
        out["bucket"].append(int(bucket[order[lo]]))
        out["block"].append(block)
        out["keys"].append(values[order[lo:hi]].tobytes())


def _shared_anchors(table: pa.Table) -> pa.Table:
    """For each block, its anchors that some other document has too."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    flagged = np.concatenate(parts)
    keys = flagged & ~np.uint64(1)
    values, counts = np.unique(keys, return_counts=True)
    shared = np.union1d(values[counts > 1], keys[(flagged & np.uint64(1)) == 1])
    blocks, blobs = [], []
    for block, part in zip(table.column("block").to_pylist(), parts):
        part = part & ~np.uint64(1)
        hit = part[_isin(part, shared)]
        if len(hit):
            blocks.append(block)
            blobs.append(hit.tobytes())
    return pa.table([pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], names=["block", "shared"])


def _isin(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


_RUN = np.dtype([("key", "<u8"), ("least", "<i8"), ("most", "<i8"), ("run", "<i8"), ("size", "<i8")])
_MARK = np.dtype([("run", "<i8"), ("offset", "<i8"), ("count", "<i8"), ("least", "<i8")])


def _runs(buckets: int):
    """Different runs at shared anchors of a block: records and bytes by bucket."""

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        block = _Block(rows, side)
        shared = np.sort(_joined(side.column("shared"), np.uint64))
        chosen = np.flatnonzero(_isin(block.key, shared))
        seen: dict[bytes, int] = {}
        firsts, of = [], np.zeros(len(chosen), np.int64)
        for n, k in enumerate(chosen.tolist()):
            data = block.run_bytes(k)
            at = seen.setdefault(data, len(firsts))
            if at == len(firsts):
                firsts.append(k)
            of[n] = at
        out = {"bucket": [], "block": [], "records": [], "bytes": []}
        if firsts:
            rec = np.zeros(len(firsts), _RUN)
            ids = block.head_ids[block.document[chosen]]
            rec["key"], rec["run"] = block.key[firsts], firsts
            rec["least"], rec["most"] = _NO_ID, -(1 << 63)
            np.minimum.at(rec["least"], of, ids)
            np.maximum.at(rec["most"], of, ids)
            datas = list(seen)
            rec["size"] = [len(d) for d in datas]
            bucket = _bucket(rec["key"], buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(order)]):
                part = order[lo:hi]
                out["bucket"].append(int(bucket[part[0]]))
                out["block"].append(rows.column("block")[0].as_py())
                out["records"].append(rec[part].tobytes())
                out["bytes"].append(b"".join([datas[k] for k in part.tolist()]))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return run


def _least_ids(table: pa.Table) -> pa.Table:
    """For each block and run, the smallest id of every string that another
    document with a smaller id has: (run, offset, count, least)."""
    records = [np.frombuffer(x, _RUN) for x in table.column("records").to_pylist()]
    blocks = table.column("block").to_pylist()
    rec = np.concatenate(records)
    seen: dict[bytes, int] = {}
    kind = np.zeros(len(rec), np.int64)
    n = 0
    for part, raw in zip(records, table.column("bytes").to_pylist()):
        at = 0
        for size in part["size"].tolist():
            kind[n] = seen.setdefault(raw[at : at + size], len(seen))
            at, n = at + size, n + 1
    kinds = list(seen)
    least = np.full(len(kinds), _NO_ID)
    np.minimum.at(least, kind, rec["least"])
    key = np.zeros(len(kinds), np.uint64)
    key[kind] = rec["key"]
    strings = np.array([len(k) for k in kinds], np.int64) - LENGTH + 1
    # stretches (kind, offset, count, least): one for a kind that is alone with its anchor
    values, counts = np.unique(key, return_counts=True)
    alone = counts[np.searchsorted(values, key)] == 1
    stretch = [(np.flatnonzero(alone), np.zeros(alone.sum(), np.int64), strings[alone], least[alone])]
    mixed = np.flatnonzero(~alone)
    if len(mixed):
        buffer = np.frombuffer(b"".join(kinds[k] for k in mixed.tolist()) + bytes(64), np.uint8)
        length = strings[mixed] + LENGTH - 1
        base = np.cumsum(length) - length
        of = np.repeat(mixed, strings[mixed])
        ahead = np.cumsum(strings[mixed]) - strings[mixed]
        offset = np.arange(len(of)) - np.repeat(ahead, strings[mixed])
        at = np.repeat(base, strings[mixed]) + offset
        order, first = sort_prefixes(buffer, at, key[of], LENGTH)
        starts = np.flatnonzero(first)
        low = np.empty(len(of), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(least[of][order], starts), np.diff(np.r_[starts, len(of)]))
        change = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (low[1:] != low[:-1])])
        stretch.append((of[change], offset[change], np.diff(np.r_[change, len(of)]), low[change]))
    s_kind, s_offset, s_count, s_least = (np.concatenate(x) for x in zip(*stretch))
    order = np.argsort(s_kind, kind="stable")
    s_kind, s_offset, s_count, s_least = s_kind[order], s_offset[order], s_count[order], s_least[order]
    lo, hi = np.searchsorted(s_kind, kind), np.searchsorted(s_kind, kind, "right")
    out_blocks, out_marks = [], []
    done = 0
    for block, part in zip(blocks, records):
        span = slice(done, done + len(part))
        done += len(part)
        many = hi[span] - lo[span]
        pick = np.repeat(lo[span] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        marks = np.zeros(len(pick), _MARK)
        marks["run"], marks["offset"] = np.repeat(part["run"], many), s_offset[pick]
        marks["count"], marks["least"] = s_count[pick], s_least[pick]
        marks = marks[marks["least"] < np.repeat(part["most"], many)]
        if len(marks):
            out_blocks.append(block)
            out_marks.append(marks.tobytes())
    return pa.table([pa.array(out_blocks, pa.int64()), pa.array(out_marks, pa.binary())], names=["block", "marks"])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(block: _Block, marks: np.ndarray) -> np.ndarray:
    """True for the bytes of the block's texts that go."""
    edge = np.zeros(len(block.data) + 1, np.int64)
    if len(marks):
        keys = np.unique(block.key[np.unique(marks["run"])])
        same: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(_isin(block.key, keys)).tolist():
            same.setdefault(block.run_bytes(k), []).append(k)
        marks = marks[np.argsort(marks["run"], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, marks["run"][1:] != marks["run"][:-1]])
        for part in np.split(marks, cuts[1:]):
            members = np.array(same[block.run_bytes(int(part["run"][0]))])
            ids = block.head_ids[block.document[members]]
            i, j = np.nonzero(part["least"][:, None] < ids[None, :])
            low = block.begin[members[j]] + part["offset"][i]
            np.add.at(edge, low, 1)
            np.add.at(edge, low + part["count"][i] - 1 + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _results(with_bytes: bool):
    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        block = _Block(rows, side)
        gone = _removed(block, _joined(side.column("marks"), _MARK))
        place = {k: n for n, k in enumerate(block.heads)}
        out = []
        for k, text in enumerate(block.texts):
            if k in place:
                lo, hi = block.starts[place[k]], block.starts[place[k] + 1]
                mask = gone[lo:hi]
                removed = int(mask.sum())
                spans = int((mask[1:] & ~mask[:-1]).sum()) + int(len(mask) > 0 and mask[0]) if removed else 0
                kept = block.data[lo:hi][~mask].tobytes() if removed else text
            elif len(text) >= LENGTH:
                removed, spans, kept = len(text), 1, b""
            else:
                removed, spans, kept = 0, 0, text
            out.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table([rows.column("doc_id"), *columns], names=["doc_id", *names])

    return run


def suffix_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row."""
    blocks = max(1, math.ceil(total_bytes(docs) / block_bytes))
    buckets = max(1, blocks // 2)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    place = lambda i: F.pmod(F.xxhash64(i, "sha"), F.lit(blocks)).alias("block")
    known = F.coalesce("doc_id", F.lit(_NO_ID))
    heads = rows.select(known.alias("id"), "sha").groupBy("sha").agg(F.min("id").alias("head"))
    heads = heads.select("head", F.col("sha").alias("head_sha"), place(F.col("head")))
    dealt = rows.select("doc_id", "text", "sha", place(known)).groupBy("block")

    def side(**extra: DataFrame) -> DataFrame:
        frame = heads
        for name, other in extra.items():
            frame = frame.unionByName(other, allowMissingColumns=True)
        return frame

    anchors = dealt.cogroup(side().groupBy("block")).applyInArrow(_anchors(buckets), "bucket long, block long, keys binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors, "block long, shared binary")
    runs = dealt.cogroup(side(shared=shared).groupBy("block")).applyInArrow(
        _runs(buckets), "bucket long, block long, records binary, bytes binary"
    )
    marks = runs.groupBy("bucket").applyInArrow(_least_ids, "block long, marks binary")
    out = dealt.cogroup(side(marks=marks).groupBy("block")).applyInArrow(_results(with_bytes), _RESULT)
    return out if with_bytes else out.drop("kept")

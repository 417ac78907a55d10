"""Vector bin packing of examples into training sequences.

A sequence has three limits: tokens, segments and loss-bearing tokens. The
dot-product heuristic fills one sequence at a time: of the waiting examples that
fit, it takes the one whose demand vector points most along what the sequence
has left (both scaled by the limits, dimensions weighted by the demand of the
waiting examples; the segment dimension is one for all, so it cancels). Examples may be cut anywhere: when none fits whole, the best
one is cut to close the gap, so a sequence ends full in one dimension.

Each input partition packs its own rows from a bounded pool of waiting rests, so
there is no shuffle and no group to outgrow a task. What a partition has left
over at its end is cut into sequences whose lengths are powers of two, which
need no padding.

Defined results: an example of no tokens gives no piece; ties take the example
that stands first in the pool; an example longer than a sequence gives full sequences first
and its rest waits; repeated rows are packed each; loss-bearing tokens are the
last ``n_loss`` tokens of an example.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surtscope.llm.vocabulary import encoder

#: Rests that wait in a task at most before sequences are closed.
POOL = 256


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


@dataclass
class Piece:
    item: int
    start: int
    length: int
    sequence: int
    offset: int


def _loss_in(start: int, length: int, loss_from: int) -> int:
    return max(0, start + length - max(start, loss_from))


class VectorPacker:
    """Packs examples as they come; yields pieces sequence by sequence."""

    def __init__(self, limits: Limits = Limits(), pool: int = POOL):
        self.limits, self.pool = limits, pool
        self._next = 0
        self._size = 0
        self._cap = 2 * pool
        self._item = np.zeros(self._cap, np.int64)
        self._start = np.zeros(self._cap, np.int64)
        self._need = np.zeros((self._cap, 3), np.float64)  # tokens, segments, loss
        self._loss_from = np.zeros(self._cap, np.int64)

    def add(self, item: int, n_tokens: int, n_loss: int) -> Iterator[Piece]:
        """Full sequences of a long example at once; its rest joins the pool."""
        start, loss_from = 0, n_tokens - n_loss
        while n_tokens - start >= self.limits.tokens:
            length = self._largest_cut(start, n_tokens - start, loss_from, self.limits.tokens, self.limits.loss)
            yield Piece(item, start, length, self._next, 0)
            self._next += 1
            start += length
        if n_tokens > start:
            self._wait(item, start, n_tokens - start, loss_from)
        if self._size >= self.pool:
            yield from self._close(self.pool // 2)

    def finish(self) -> Iterator[Piece]:
        yield from self._close(0)

    def _wait(self, item: int, start: int, length: int, loss_from: int) -> None:
        k = self._size
        if k == self._cap:
            raise RuntimeError("the pool holds at most twice its limit")
        self._item[k], self._start[k], self._loss_from[k] = item, start, loss_from
        self._need[k] = length, 1, _loss_in(start, length, loss_from)
        self._size += 1

    def _remove(self, k: int) -> None:
        """The last rest takes the place of the k-th."""
        self._size -= 1
        for a in (self._item, self._start, self._need, self._loss_from):
            a[k] = a[self._size]

    @staticmethod
    def _largest_cut(start: int, length: int, loss_from: int, tokens: int, loss: int) -> int:
        """Most tokens from ``start`` within what is left of tokens and loss."""
        free = max(0, loss_from - start)
        return min(length, tokens, free + loss)

    def _close(self, keep: int) -> Iterator[Piece]:
        """Close sequences until at most ``keep`` rests wait."""
        while self._size > keep:
            yield from self._padded_or_cut(self._one_sequence())

    def _one_sequence(self) -> list[Piece]:
        """One sequence. Every example is one segment, so that dimension decides
        when a sequence ends but not which example comes next."""
        limits, pieces, offset = self.limits, [], 0
        tokens, segments, loss = limits.tokens, limits.segments, limits.loss
        n = self._size
        token_weight = self._need[:n, 0].sum() / limits.tokens**3
        loss_weight = self._need[:n, 2].sum() / limits.loss**3
        while self._size and tokens > 0 and segments > 0 and loss > 0:
            need_tokens, need_loss = self._need[: self._size, 0], self._need[: self._size, 2]
            score = need_tokens * (token_weight * tokens) + need_loss * (loss_weight * loss)
            fitting = np.where((need_tokens <= tokens) & (need_loss <= loss), score, -1.0)
            k = int(fitting.argmax())
            start, loss_from = int(self._start[k]), int(self._loss_from[k])
            length = int(need_tokens[k])
            if fitting[k] < 0:
                k = int(score.argmax())
                start, loss_from = int(self._start[k]), int(self._loss_from[k])
                length = self._largest_cut(start, int(need_tokens[k]), loss_from, tokens, loss)
            item, rest = int(self._item[k]), int(need_tokens[k]) - length
            tokens, segments, loss = tokens - length, segments - 1, loss - _loss_in(start, length, loss_from)
            if rest:
                self._start[k] = start + length
                self._need[k] = rest, 1, _loss_in(start + length, rest, loss_from)
            else:
                self._remove(k)
            pieces.append(Piece(item, start, length, self._next, offset))
            offset += length
        self._next += 1
        return pieces

    def _padded_or_cut(self, pieces: list[Piece]) -> list[Piece]:
        """A sequence that is not full, cut into sequences of 2**k tokens."""
        total = sum(p.length for p in pieces)
        if total == self.limits.tokens or total & (total - 1) == 0:
            return pieces
        out, room, offset = [], 1 << (total.bit_length() - 1), 0
        for p in pieces:
            start, length = p.start, p.length
            while length:
                take = min(length, room - offset)
                out.append(Piece(p.item, start, take, self._next - 1, offset))
                start, length, offset, total = start + take, length - take, offset + take, total - take
                if offset == room and total:
                    room, offset = 1 << (total.bit_length() - 1), 0
                    self._next += 1
        return out


def _sequence_base() -> int:
    """Sequence ids of a task start here; 2**33 for each partition."""
    return TaskContext.get().partitionId() << 33


_EXAMPLE_PIECES = "example_id long, start long, length long, sequence_id long, offset long"


def pack_examples(examples: DataFrame, limits: Limits = Limits(), pool: int = POOL) -> DataFrame:
    """Pieces of examples given as (example_id, n_tokens, n_loss)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = VectorPacker(limits, pool), _sequence_base()

        def batch(pieces):
            return pa.RecordBatch.from_pylist(
                [
                    dict(example_id=p.item, start=p.start, length=p.length, sequence_id=base + p.sequence, offset=p.offset)
                    for p in pieces
                ],
                pa.schema([(c, pa.int64()) for c in ("example_id", "start", "length", "sequence_id", "offset")]),
            )

        for b in batches:
            out = []
            for item, n, loss in zip(*(b.column(c).to_pylist() for c in ("example_id", "n_tokens", "n_loss"))):
                out += packer.add(item, n or 0, min(loss or 0, n or 0))
            yield batch(out)
        yield batch(packer.finish())

    return examples.select("example_id", "n_tokens", "n_loss").mapInArrow(run, _EXAMPLE_PIECES)


_TEXT_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)
_TEXT_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("ids", pa.binary())]
)
_END = (0).to_bytes(4, "little")
_FLUSH = 4000


def pack_texts(
    docs: DataFrame, *vocabulary, limits: Limits = Limits(), pool: int = POOL, with_ids: bool = True
) -> DataFrame:
    """Pieces of texts: the ids of a text, then id 0, every token loss-bearing.

    ``vocabulary`` is the path of a tokenizer file that every executor has, and
    optionally what ``vocabulary.encoder`` takes besides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base, encode = VectorPacker(limits, pool), _sequence_base(), encoder(*vocabulary).encode
        waiting: dict[int, list] = {}  # item -> [doc_id, ids, tokens not yet placed]
        rows: list[tuple] = []
        serial = 0

        def place(pieces) -> None:
            for p in pieces:
                entry = waiting[p.item]
                ids = entry[1][4 * p.start : 4 * (p.start + p.length)]
                rows.append(
                    (entry[0], p.start, p.length, zlib.crc32(ids), len(entry[1]) // 4, base + p.sequence, p.offset,
                     ids if with_ids else None)
                )
                entry[2] -= p.length
                if not entry[2]:
                    del waiting[p.item]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _TEXT_SCHEMA)] if rows else
                [pa.array([], f.type) for f in _TEXT_SCHEMA],
                schema=_TEXT_SCHEMA,
            )
            rows.clear()
            return batch

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                ids = encode(text.as_py() or "") + _END
                n = len(ids) // 4
                waiting[serial] = [doc_id.as_py(), ids, n]
                place(packer.add(serial, n, n))
                serial += 1
                if len(rows) >= _FLUSH:
                    yield flush()
        place(packer.finish())
        yield flush()

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _TEXT_PIECES)
    return out if with_ids else out.drop("ids")

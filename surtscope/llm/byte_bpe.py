"""Byte-level BPE as a monoid: encodings of neighbours join into one encoding.

A piece (one match of the split pattern) is halved down to short leaves. Leaves
are merged by rank, lowest first. Two encoded halves are joined by re-encoding a
window of tokens around the seam; while the window's outermost tokens do not
agree with their neighbours outside, it grows on that side.

Why that is exact: tokens t1..tn are the encoding of their bytes if and only if
each neighbouring pair (ti, ti+1) is the encoding of its own bytes, because the
first merge ever to cross a seam depends on the two tokens beside it alone. Pairs
inside each half and inside the re-encoded window hold already, so only the pairs
at the window's two ends need a look. A window that has reached both outer ends
is the encoding by definition.

Pieces never merge with each other, so texts join by concatenation. A piece that
is itself a token is that token, as the rank files are defined. Decoding
concatenates the bytes of tokens up the same tree.

Defined results: NULL and empty texts have no tokens; texts of any length are
encoded whole; repeated rows repeat their result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a piece is merged directly.
LEAF_BYTES = 16
#: Tokens on each side of a seam that the first window re-encodes.
WINDOW = 4
_MEMO_PIECES = 400_000
_NO_RANK = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBPE:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = LEAF_BYTES, window: int = WINDOW):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # white space as the Unicode property: the regex module's own \s is wider
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.leaf_bytes, self.window = leaf_bytes, window
        self._memo: dict[str, bytes] = {}
        self._agree: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge bytes by rank: lowest first, leftmost first among equals.

        ``near`` holds the rank of each neighbouring pair; a merge renews the two beside it.
        """
        rank = self.ranks.get
        starts = list(range(len(data) + 1))
        near = [rank(data[k : k + 2], _NO_RANK) for k in range(len(data) - 1)]
        while near:
            best = min(near)
            if best == _NO_RANK:
                break
            k = near.index(best)
            del starts[k + 1], near[k]
            if k:
                near[k - 1] = rank(data[starts[k - 1] : starts[k + 1]], _NO_RANK)
            if k < len(near):
                near[k] = rank(data[starts[k] : starts[k + 2]], _NO_RANK)
        return [self.ranks[data[s:e]] for s, e in zip(starts, starts[1:])]

    def agrees(self, left: int, right: int) -> bool:
        """The two tokens are the encoding of their joint bytes."""
        key = (left, right)
        known = self._agree.get(key)
        if known is None:
            if len(self._agree) > _MEMO_PIECES:
                self._agree.clear()
            known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self._agree[key] = known
        return known

    def tree(self, data: bytes) -> list[int]:
        """Encode halves and join them."""
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right or self.agrees(left[-1], right[0]):
            return left + right
        a = b = self.window
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            inside = self.merge(b"".join(self.tokens[t] for t in left[len(left) - a :] + right[:b]))
            good_left = a == len(left) or self.agrees(left[len(left) - a - 1], inside[0])
            good_right = b == len(right) or self.agrees(inside[-1], right[b])
            if good_left and good_right:
                return left[: len(left) - a] + inside + right[b:]
            a, b = (a if good_left else 2 * a), (b if good_right else 2 * b)

    def piece(self, piece: str) -> bytes:
        """Ids of one match of the pattern, as little-endian 32-bit bytes."""
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.tree(data)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit bytes."""
        memo, out = self._memo, []
        if len(memo) > _MEMO_PIECES:
            memo.clear()
        for piece in self.pattern.findall(text):
            found = memo.get(piece)
            if found is None:
                found = self.piece(piece)
                if len(piece) < 200:
                    memo[piece] = found
            out.append(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a text from its ids, concatenated up a tree, 256 nodes at a time."""
        level = [self.tokens[t] for t in np.frombuffer(ids, "<u4").tolist()]
        while len(level) > 1:
            level = [b"".join(level[k : k + 256]) for k in range(0, len(level), 256)]
        return level[0] if level else b""


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec for each rank file, pattern and process."""
    return ByteBPE(read_ranks(path), pattern)


_CODED = "doc_id long, ids binary, decoded binary"


def encode_texts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian 32-bit integers, and their bytes again."""
    return _mapped(docs, ranks, pattern, lambda ids, body: (ids, body), _CODED, (pa.binary(), pa.binary()))


def digest_texts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without shipping ids."""

    def digest(ids: bytes, body: bytes):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(body).hexdigest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, ranks, pattern, digest, schema, (pa.int64(), pa.string(), pa.string()))


def _mapped(docs: DataFrame, ranks: str, pattern: str, make, schema: str, types: tuple) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks, pattern)
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                rows = []
                for text in part.column("text"):
                    ids = coder.encode(text.as_py() or "")
                    rows.append(make(ids, coder.decode(ids)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

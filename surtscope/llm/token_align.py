"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

A text is encoded by a byte-level BPE vocabulary (left) and a sentence-piece model
(right). Both cover the bytes of a space and the text; where tokens of both end at
one byte, a group ends. ``align`` walks the two arrays of token ends at the current
shift between their indices: slices of doubling width are compared at that shift, so
stretches of one-to-one groups are jumped, and a slice that differs is halved down to
the first token that does. The irregular group there is resolved token by token, the
side that ends first moving on, and the walk goes on at the new shift.

A link is a pair of tokens that share bytes. How often each pair of ids is linked is
counted over all texts, combined before the shuffle. To read the counts back, the
``HEAD`` most frequent pairs are broadcast: their number is fixed, and they hold nearly
all links, so that no frequent pair is ever a shuffle key. Links of the other, rare
pairs are joined by a shuffle.

Defined results: texts that are NULL or empty, and texts whose tokens do not give the
bytes of space + text back on both sides (the right model takes U+2581 for a space),
have no tokens: zeros, and '' for groups; repeated rows and repeated or NULL doc_ids
count as documents of their own; an empty table gives no rows; strings of special
tokens inside texts are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surtscope.llm.common import materialise

#: Pairs of ids whose counts are sent to every task.
HEAD = 1 << 17
#: Bytes of text that are encoded in one call.
_BATCH_BYTES = 1 << 18
#: Characters up to which a text may go to the rank-file encoder, which looks ahead
#: over runs of white space within a fixed budget.
_RANKED_CHARS = 1 << 18


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    Latin-1 characters stand for themselves, the others for characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class LeftEncoder:
    """Byte-level BPE from its JSON file. Texts in Latin-1 take the rank file of the same
    vocabulary where one is given, on whose characters both libraries agree."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str = ""):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(path)
        self._exact.encode_special_tokens = True
        byte_of = byte_symbols()
        vocabulary = self._exact.get_vocab(with_added_tokens=False)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            tokens[k] = bytes(byte_of[c] for c in token)
        self.side = _Side(tokens)
        self._ranked = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
            self._ranked = tiktoken.Encoding("left", pat_str=pattern, mergeable_ranks=known, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        found: list = [None] * len(texts)
        others = []
        for k, text in enumerate(texts):
            if self._ranked and len(text) <= _RANKED_CHARS and _is_latin(text):
                found[k] = self._ranked.encode_ordinary(text)
            else:
                others.append(k)
        if others:
            encoded = self._exact.encode_batch_fast([texts[k] for k in others], add_special_tokens=False)
            for k, e in zip(others, encoded):
                found[k] = e.ids
        return found


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class RightEncoder:
    """A sentence-piece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.side = _Side([self._bytes_of(k) for k in range(self._model.get_piece_size())])

    def _bytes_of(self, k: int) -> bytes:
        piece = self._model.id_to_piece(k)
        if self._model.is_byte(k):
            return bytes([int(re.fullmatch("<0x(..)>", piece)[1], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def encoders(left: tuple, right: str) -> tuple[LeftEncoder, RightEncoder]:
    """Both encoders, once for each process."""
    return LeftEncoder(*left), RightEncoder(right)


@dataclass(frozen=True)
class Alignment:
    """Links in order, as positions in a and in b, and the group of each token."""

    links_a: np.ndarray
    links_b: np.ndarray
    groups_a: np.ndarray
    groups_b: np.ndarray

    @property
    def n_groups(self) -> int:
        return int(self.groups_a[-1]) + 1 if len(self.groups_a) else 0


def align(ends_a: Sequence[int], ends_b: Sequence[int]) -> Alignment:
    """Walk two token sequences over the same bytes, given by their ends."""
    a_stays, b_stays = [], []  # links that differ from the one before on one side only
    i = j = n_links = 0
    n = len(ends_a)
    while i < n:
        start, width = i, 1
        while ends_a[i : i + width] == ends_b[j : j + width]:
            i, j = i + width, j + width
            if i >= n:
                i, j = n, j - i + n
                break
            width *= 2
        while width > 1 and i < n:
            width //= 2
            if ends_a[i : i + width] == ends_b[j : j + width]:
                step = min(width, n - i)
                i, j = i + step, j + step
        n_links += i - start
        if i < n:
            end_a, end_b = ends_a[i], ends_b[j]
            n_links += 1
            while end_a != end_b:
                if end_a < end_b:
                    i += 1
                    end_a = ends_a[i]
                    b_stays.append(n_links)
                else:
                    j += 1
                    end_b = ends_b[j]
                    a_stays.append(n_links)
                n_links += 1
            i, j = i + 1, j + 1
    moves_a, moves_b = np.ones(n_links, bool), np.ones(n_links, bool)
    moves_a[a_stays] = False
    moves_b[b_stays] = False
    group = np.cumsum(moves_a & moves_b) - 1  # a link that moves on on both sides opens a group
    return Alignment(np.cumsum(moves_a) - 1, np.cumsum(moves_b) - 1, group[moves_a], group[moves_b])


def written(found: Alignment, a: np.ndarray, b: np.ndarray, side_a: _Side, side_b: _Side) -> str:
    """The groups as ``a1,a2|b1;a3|b2,b3``: each token with what follows it, in order."""
    last_a = np.diff(found.groups_a, append=-1) != 0
    last_b = np.diff(found.groups_b, append=-1) != 0
    out = np.empty(len(a) + len(b), object)
    before_a = np.searchsorted(found.groups_b, found.groups_a)
    before_b = np.searchsorted(found.groups_a, found.groups_b, side="right")
    out[np.arange(len(a)) + before_a] = np.where(last_a, side_a.written("|")[a], side_a.written(",")[a])
    out[np.arange(len(b)) + before_b] = np.where(last_b, side_b.written(";")[b], side_b.written(",")[b])
    return "".join(out.tolist())[:-1]


class _Side:
    """Bytes, lengths and written ids of one vocabulary's tokens, looked up in bulk."""

    def __init__(self, tokens: list[bytes]):
        self._tokens = np.empty(len(tokens), object)
        self._tokens[:] = tokens
        self._lengths = np.array([len(t) for t in tokens], np.int64)

    def body(self, ids: np.ndarray) -> bytes:
        return b"".join(self._tokens[ids].tolist())

    @cache
    def written(self, mark: str) -> np.ndarray:
        """Every id in decimal, with a mark behind it."""
        found = np.empty(len(self._tokens), object)
        found[:] = [f"{k}{mark}" for k in range(len(found))]
        return found

    def ends(self, ids: np.ndarray) -> array:
        found = array("q")
        found.frombytes(np.cumsum(self._lengths[ids]).tobytes())
        return found


def _aligned_text(text: str, a: list[int], b: list[int], side_a: _Side, side_b: _Side):
    """(tokens of a, tokens of b, number of groups, groups, distinct pairs, their times)."""
    ids_a, ids_b, body = np.array(a, np.int64), np.array(b, np.int64), b" " + text.encode()
    if not text or side_a.body(ids_a) != body or side_b.body(ids_b) != body:
        return 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = align(side_a.ends(ids_a), side_b.ends(ids_b))
    pairs, times = np.unique(ids_a[found.links_a] << 32 | ids_b[found.links_b], return_counts=True)
    return len(a), len(b), found.n_groups, written(found, ids_a, ids_b, side_a, side_b), pairs, times


def _slices(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about ``_BATCH_BYTES`` characters."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= _BATCH_BYTES:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<struct<pair: long, times: long>>"


def alignments(docs: DataFrame, left: tuple, right: str, with_groups: bool = True) -> DataFrame:
    """One row for each document: token and group counts, the groups (or only their
    SHA-256), and the distinct linked pairs of ids (left << 32 | right) with their times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_a, encoder_b = encoders(left, right)
        sides = encoder_a.side, encoder_b.side
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in _slices(texts):
                some = texts[part]
                encoded = zip(some, encoder_a.encode([" " + t for t in some]), encoder_b.encode(some))
                found = [_aligned_text(t, a, b, *sides) for t, a, b in encoded]
                n_a, n_b, n_groups, groups, pairs, times = zip(*found)
                if not with_groups:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                offsets = pa.array(np.cumsum([0, *map(len, pairs)]).astype(np.int32))
                linked = pa.StructArray.from_arrays(
                    [pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times).astype(np.int64))], names=["pair", "times"]
                )
                counts = [pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups)]
                keys = [batch.column(c).slice(part.start, len(some)) for c in ("row", "doc_id")]
                yield pa.RecordBatch.from_arrays(
                    [*keys, *counts, pa.array(groups, pa.string()), pa.ListArray.from_arrays(offsets, linked)],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs"],
                )

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return keyed.mapInArrow(run, _ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair of ids over all texts, and whether no other
    pair of the same right id has more."""
    counts = links.groupBy("pair").agg(F.sum("times").alias("n"))
    # a right id meets at most the left vocabulary
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return counts.withColumn("best", F.col("n") == most)


def _sums(links: DataFrame, counts: DataFrame, head: int) -> DataFrame:
    """(row, n_links, n_best, count_sum)."""
    frequent = F.broadcast(counts.orderBy(F.col("n").desc(), "pair").limit(head))
    hit = links.join(frequent, "pair")
    rare = links.join(frequent.select("pair"), "pair", "left_anti").join(counts, "pair")
    sums = [
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    ]
    parts = [side.groupBy("row").agg(*sums) for side in (hit, rare)]
    return parts[0].union(parts[1]).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])


def align_corpus(docs: DataFrame, left: tuple, right: str, with_groups: bool = True, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every document;
    without ``with_groups`` the last column is ``groups_sha256``."""
    aligned = materialise(alignments(docs, left, right, with_groups), "align-texts")
    links = aligned.select("row", F.inline("pairs"))
    counts = materialise(pair_counts(links), "align-counts")
    sums = _sums(links, counts, head)
    totals = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")]
    name = "groups" if with_groups else "groups_sha256"
    return (
        aligned.drop("pairs")
        .join(sums, "row", "left")
        .select("doc_id", "n_a", "n_b", "n_groups", *totals, F.col("groups").alias(name))
    )

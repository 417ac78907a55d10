"""Katz backoff language model of word pairs, counted and looked up block by block.

Probability of a token w after a history h (the word before, or the start):

    seen pair    d(c(h,w)) * c(h,w) / (c(h) + SLACK)
    unseen pair  alpha(h) * P(w)
    unseen h     P(w)

d are Good-Turing discounts for counts up to ``K``; P adds 0.1 to every count of a
word and to one class of unknown words, so it sums to one; alpha(h) is the mass
that h's discounted pairs leave, divided by the P-mass of the words not seen after
h, so every history's distribution sums to one exactly. SLACK keeps some mass for
unseen words after histories whose pairs are all frequent.

Words and pairs are known by 64-bit hashes. A block of documents asks for its
different words, then for its different pairs, with its own training counts; the
bucket that a hash belongs to adds up all blocks and answers each block; the stored
answers hold no words or histories, so other texts cannot be scored from them. Pairs live in the bucket of
their history; a history with more than ``SPLIT`` occurrences is spread over several
buckets, whose partial sums the blocks add. A word or history that makes up a third
of all tokens therefore costs one record for each block, not one for each token.

Defined results: NULL text is empty and has the end token alone; a NULL doc_id
counts as the text '' for the fold; without training rows every token has the
probability of an unknown word; repeated rows repeat their result and each counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtscope.llm.common import crc_bucket, materialise, total_bytes

K = 5
SLACK = 0.1
ADD = 0.1
BLOCK_BYTES = 16 << 20
#: Occurrences of a history that one bucket holds.
SPLIT = 1 << 24
END = b" "
_START_HASH = np.uint64(0x5354415254)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _squeeze(values: np.ndarray, dtype: str) -> bytes:
    """Integers as compressed byte planes."""
    raw = np.ascontiguousarray(values.astype(dtype)).view(np.uint8).reshape(len(values), np.dtype(dtype).itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _widen(data: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _spread(hashes: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((hashes * _MULTIPLIER) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class _Tokens:
    """Tokens of a block: local word numbers, histories and folds."""

    def __init__(self, rows: pa.Table):
        numbers: dict[bytes, int] = {END: 0}
        ids: list[int] = []
        sizes = []
        for text in rows.column("text").cast(pa.binary()).to_pylist():
            words = text.lower().split()
            ids.extend([numbers.setdefault(w, len(numbers)) for w in words])
            ids.append(0)
            sizes.append(len(words) + 1)
        self.word = np.array(ids, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.n_words = len(numbers)
        self.start = self.n_words  # the history at the start of a text
        self.history = np.empty_like(self.word)
        self.history[1:] = self.word[:-1]
        self.history[self.first] = self.start
        self.hash = np.array([xxhash.xxh3_64_intdigest(w) for w in numbers] + [int(_START_HASH)], np.uint64)
        training = rows.column("training").to_numpy(zero_copy_only=False).astype(bool)
        self.training = np.repeat(training, self.sizes)

    def word_order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Local words by (bucket, hash), and the buckets along it."""
        bucket = _spread(self.hash[: self.n_words], buckets)
        order = np.lexsort((self.hash[: self.n_words], bucket))
        return order, bucket[order]


def _cuts(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_values):
        return []
    at = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return list(zip(at.tolist(), np.r_[at[1:], len(sorted_values)].tolist()))


_ASK = "bucket long, block long, hashes binary, numbers binary"


def _ask_words(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        t = _Tokens(rows)
        counts = np.bincount(t.word[t.training], minlength=t.n_words)
        order, bucket = t.word_order(buckets)
        out = []
        for lo, hi in _cuts(bucket):
            part = order[lo:hi]
            out.append((int(bucket[lo]), t.hash[part].tobytes(), _squeeze(counts[part], "<u4")))
        block = rows.column("block")[0].as_py()
        return pa.table(
            [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([block] * len(out), pa.int64()),
                pa.array([x[1] for x in out], pa.binary()),
                pa.array([x[2] for x in out], pa.binary()),
            ],
            names=["bucket", "block", "hashes", "numbers"],
        )

    return run


_WORDS = "bucket long, block long, counts binary, n_tokens long, n_words long"


def _count_words(table: pa.Table) -> pa.Table:
    """Totals for each block's words; the bucket's sums stand in its first row."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    keys = np.concatenate(parts)
    numbers = np.concatenate([_widen(x, "<u4") for x in table.column("numbers").to_pylist()]).astype(np.int64)
    values, inverse = np.unique(keys, return_inverse=True)
    totals = np.zeros(len(values), np.int64)
    np.add.at(totals, inverse, numbers)
    answer = np.split(totals[inverse], np.cumsum([len(p) for p in parts])[:-1])
    n = len(parts)
    return pa.table(
        [
            table.column("bucket"),
            table.column("block"),
            pa.array([_squeeze(a, "<i8") for a in answer], pa.binary()),
            pa.array([int(totals.sum())] + [0] * (n - 1), pa.int64()),
            pa.array([int((totals > 0).sum())] + [0] * (n - 1), pa.int64()),
        ],
        names=["bucket", "block", "counts", "n_tokens", "n_words"],
    )


def _word_counts(t: _Tokens, side: pa.Table, buckets: int, n_texts: int) -> np.ndarray:
    """Corpus counts of the block's words, then of the start."""
    known = {b: c for b, c in zip(side.column("bucket").to_pylist(), side.column("counts").to_pylist()) if c is not None}
    order, bucket = t.word_order(buckets)
    counts = np.zeros(t.n_words + 1, np.int64)
    for lo, hi in _cuts(bucket):
        counts[order[lo:hi]] = _widen(known[int(bucket[lo])], "<i8")
    counts[t.start] = n_texts
    return counts


class _Pairs:
    """Different pairs of a block in the order in which buckets are asked.

    A history beyond ``split`` occurrences asks each of its buckets once more with
    word hash 0, so that it learns about all of its successors.
    """

    def __init__(self, t: _Tokens, counts: np.ndarray, buckets: int, split: int):
        width = t.n_words + 1
        code, inverse = np.unique(t.history * width + t.word, return_inverse=True)
        trained = np.bincount(inverse[t.training], minlength=len(code))
        history, word = code // width, code % width
        shares = 1 + counts[:width] // split
        with np.errstate(over="ignore"):
            salt = (t.hash[word] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
        share = (salt % shares[history].astype(np.uint64)).astype(np.int64)
        hot = np.unique(history[shares[history] > 1])
        probe_h = np.repeat(hot, shares[hot])
        probe_s = np.concatenate([np.arange(n) for n in shares[hot]]) if len(hot) else hot
        self.real = np.r_[np.ones(len(code), bool), np.zeros(len(probe_h), bool)]
        self.history = np.r_[history, probe_h]
        self.word = np.r_[word, np.zeros(len(probe_h), np.int64)]
        self.word_hash = np.where(self.real, t.hash[self.word], np.uint64(0))
        self.trained = np.r_[trained, np.zeros(len(probe_h), np.int64)]
        share = np.r_[share, probe_s]
        self.bucket = (_spread(t.hash[self.history], buckets) + share) % buckets
        # one history's shares are told apart where they fall into one bucket
        self.history_hash = t.hash[self.history]
        self.order = np.lexsort((self.word_hash, self.history_hash, self.bucket))
        self.inverse = inverse


def _ask_pairs(buckets: int, split: int, n_texts: int):
    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        t = _Tokens(rows)
        counts = _word_counts(t, side, buckets, n_texts)
        p = _Pairs(t, counts, buckets, split)
        block = rows.column("block")[0].as_py()
        out = {"bucket": [], "block": [], "hashes": [], "numbers": [], "heads": [], "runs": [], "lower": []}
        for lo, hi in _cuts(p.bucket[p.order]):
            part = p.order[lo:hi]
            h = p.history_hash[part]
            heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            out["bucket"].append(int(p.bucket[part[0]]))
            out["block"].append(block)
            out["hashes"].append(p.word_hash[part].tobytes())
            out["numbers"].append(_squeeze(p.trained[part], "<u4"))
            out["heads"].append(h[heads].tobytes())
            out["runs"].append(_squeeze(np.diff(np.r_[heads, len(h)]), "<u4"))
            out["lower"].append(_squeeze(counts[p.word[part]], "<i8"))
        types = [pa.int64(), pa.int64()] + [pa.binary()] * 5
        return pa.table([pa.array(v, ty) for v, ty in zip(out.values(), types)], names=list(out))

    return run


_PAIRS = "bucket long, block long, totals binary, at binary, sums binary, low binary, classes array<long>"


def _count_pairs(n_tokens: int, n_words: int):
    """Totals of pairs. For histories with an unseen pair in a block, also what
    their backoff weight needs: pairs seen 1..K times, occurrences of pairs seen
    more often, and the lower-order mass of the words seen."""
    unit = n_tokens + ADD * (n_words + 1)

    def run(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        heads = [np.frombuffer(x, np.uint64) for x in table.column("heads").to_pylist()]
        runs = [_widen(x, "<u4") for x in table.column("runs").to_pylist()]
        w = np.concatenate(words)
        h = np.concatenate([np.repeat(a, b) for a, b in zip(heads, runs)])
        n = np.concatenate([_widen(x, "<u4") for x in table.column("numbers").to_pylist()]).astype(np.int64)
        lower = np.concatenate([_widen(x, "<i8") for x in table.column("lower").to_pylist()])
        order = np.lexsort((w, h))
        hs, ws = h[order], w[order]
        first = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])])
        totals = np.add.reduceat(n[order], first)
        per_record = np.empty(len(w), np.int64)
        per_record[order] = np.repeat(totals, np.diff(np.r_[first, len(w)]))
        # of each history
        pair_h = hs[first]
        begin = np.flatnonzero(np.r_[True, pair_h[1:] != pair_h[:-1]])
        names = pair_h[begin]
        seen = totals > 0
        share = np.where(seen, (lower[order][first] + ADD) / unit, 0.0)
        sums = np.stack(
            [np.add.reduceat((totals == r).astype(np.int64), begin) for r in range(1, K + 1)]
            + [np.add.reduceat(np.where(totals > K, totals, 0), begin)],
            axis=1,
        )
        low = np.add.reduceat(share, begin)
        classes = [int((totals == r).sum()) for r in range(1, K + 2)]
        out = {"totals": [], "at": [], "sums": [], "low": [], "classes": []}
        done = 0
        for k, (a, b) in enumerate(zip(heads, runs)):
            part = per_record[done : done + int(b.sum())]
            done += len(part)
            cuts = np.cumsum(b) - b
            open_ = np.flatnonzero(np.minimum.reduceat(part, cuts.astype(np.int64)) == 0)
            where = np.searchsorted(names, a[open_])
            out["totals"].append(_squeeze(part, "<i8"))
            out["at"].append(_squeeze(open_, "<u4"))
            out["sums"].append(_squeeze(sums[where].ravel(), "<i8"))
            out["low"].append(low[where].tobytes())
            out["classes"].append(classes if k == 0 else [0] * (K + 1))
        types = [pa.binary()] * 4 + [pa.list_(pa.int64())]
        return pa.table(
            [table.column("bucket"), table.column("block"), *(pa.array(v, ty) for v, ty in zip(out.values(), types))],
            names=["bucket", "block", *out],
        )

    return run


def good_turing(classes: list[int]) -> np.ndarray:
    """Discounts d(1)..d(K) from the numbers of pairs seen 1..K+1 times; 1 where
    the estimate does not lie in (0, 1]."""
    d = np.ones(K)
    n = classes
    if n[0] > 0:
        common = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] > 0 and n[r] > 0 and common < 1:
                value = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common)
                if 0 < value <= 1:
                    d[r - 1] = value
    return d


def backoff_weight(sums: np.ndarray, low: np.ndarray, count: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    """alpha(h): mass left over by mass to fill."""
    held = sums[:, :K] @ (discounts * np.arange(1, K + 1)) + sums[:, K]
    return (1 - held / (count + SLACK)) / (1 - low)


_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _score(buckets: int, split: int, n_texts: int, n_tokens: int, n_words: int, discounts: np.ndarray):
    unit = n_tokens + ADD * (n_words + 1)

    def run(rows: pa.Table, side: pa.Table) -> pa.Table:
        t = _Tokens(rows)
        counts = _word_counts(t, side, buckets, n_texts)
        p = _Pairs(t, counts, buckets, split)
        answers = {
            b: x
            for b, *x in zip(*(side.column(c).to_pylist() for c in ("bucket", "totals", "at", "sums", "low")))
            if x[0] is not None
        }
        totals = np.zeros(len(p.order), np.int64)
        sums = np.zeros((t.n_words + 1, K + 1), np.int64)
        low = np.zeros(t.n_words + 1)
        for lo, hi in _cuts(p.bucket[p.order]):
            part = p.order[lo:hi]
            total, at, s, mass = answers[int(p.bucket[part[0]])]
            totals[part] = _widen(total, "<i8")
            h = p.history_hash[part]
            heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            local = p.history[part[heads[_widen(at, "<u4")]]]
            sums[local] += _widen(s, "<i8").reshape(-1, K + 1)
            low[local] += np.frombuffer(mass, np.float64)
        totals, history, word = totals[p.real], p.history[p.real], p.word[p.real]
        base = np.log10((counts + ADD) / unit)
        seen_history = counts[history] > 0
        ratio = np.ones(K + 1)
        ratio[1:] = discounts
        d = np.where(totals > K, 1.0, ratio[np.minimum(totals, K)])
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.log10(d * totals / (counts[history] + SLACK))
            weight = np.log10(backoff_weight(sums[history], low[history], counts[history], discounts))
        logp = np.where(totals > 0, seen, base[word] + np.where(seen_history, weight, 0.0))
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "held_out": pa.array(~rows.column("training").to_numpy(zero_copy_only=False).astype(bool)),
                "n_tokens": pa.array(t.sizes),
                "n_known": pa.array(np.add.reduceat((counts[t.word] > 0).astype(np.int64), t.first)),
                "train_tokens": pa.array(np.full(len(t.sizes), n_tokens, np.int64)),
                "base_score": pa.array(np.add.reduceat(base[t.word], t.first)),
                "score": pa.array(np.add.reduceat(logp[p.inverse], t.first)),
            }
        )

    return run


def in_training(doc_id: Column) -> Column:
    return crc_bucket(doc_id, 10) != 0


def score_texts(docs: DataFrame, training: Column | None = None, block_bytes: int = BLOCK_BYTES, split: int = SPLIT) -> DataFrame:
    """Learn from the rows of ``training`` and score all rows."""
    training = in_training(F.col("doc_id")) if training is None else training
    blocks = max(1, math.ceil(total_bytes(docs) / block_bytes))
    buckets = 2 * blocks
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"),
        text.alias("text"),
        training.alias("training"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).alias("block"),
    )
    n_texts = rows.where("training").count()
    dealt = rows.groupBy("block")
    words = dealt.applyInArrow(_ask_words(buckets), _ASK).groupBy("bucket").applyInArrow(_count_words, _WORDS)
    words = materialise(words, "katz-words")
    size = words.agg(F.sum("n_tokens").alias("n"), F.sum("n_words").alias("v")).first()
    n_tokens, n_words = size.n or 0, size.v or 0
    asked = dealt.cogroup(words.groupBy("block")).applyInArrow(
        _ask_pairs(buckets, split, n_texts), _ASK + ", heads binary, runs binary, lower binary"
    )
    pairs = materialise(asked.groupBy("bucket").applyInArrow(_count_pairs(n_tokens, n_words), _PAIRS), "katz-pairs")
    found = pairs.select(*(F.sum(F.get("classes", F.lit(r))).alias(f"n{r}") for r in range(K + 1))).first()
    discounts = good_turing([x or 0 for x in found])
    side = words.unionByName(pairs.drop("classes"), allowMissingColumns=True)
    return dealt.cogroup(side.groupBy("block")).applyInArrow(
        _score(buckets, split, n_texts, n_tokens, n_words, discounts), _SCORES
    )

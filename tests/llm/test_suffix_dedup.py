"""Repeated passages against brute force; the suffix sort against plain sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surtscope.llm import suffix_dedup
from surtscope.llm.deep_shallow import sort_prefixes

PASSAGE = "this passage of words is long enough to be found again in another text, é included. "


def brute(rows):
    least = {}
    data = [(i if i is not None else 1 << 70, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            least[s] = min(i, least.get(s, i))
    out = Counter()
    for (doc_id, _), (i, b) in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def odd():
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choices("abcdeé", k=rnd.randint(2, 7))) for _ in range(n))
    base = words(60)
    near = [base[:k] + rnd.choice("xyz") + base[k + 1 :] for k in (3, 90, 91, 150, 200)]
    return [
        (5, words(30) + PASSAGE + words(20)), (3, PASSAGE * 2), (9, words(10) + PASSAGE[10:70] + words(10)), (2, None), (4, ""),
        (8, "a" * 400), (7, "a" * 120), (6, "ab" * 100), (10, base), *((20 + k, t) for k, t in enumerate(near)),
        (30, base), (31, base), (31, base), (None, base + PASSAGE), (None, PASSAGE), (11, PASSAGE[:49]), (12, PASSAGE[:49]),
        (13, PASSAGE[:40]), (7, base[30:200]), (7, base[30:190]), (14, "\x00" * 60 + PASSAGE[:30]),
    ]


@pytest.mark.parametrize("block_bytes", [300, 4 << 20])
def test_odd_rows(rows, block_bytes):
    data = odd()
    df = rows("doc_id long, text string, sha string, block long", *((*r, "x", 1) for r in data))
    out = suffix_dedup.suffix_dedup(df, block_bytes).collect()
    assert Counter(tuple(r)[:5] for r in out) == brute(data)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in out)


def test_given_rows_and_empty_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = suffix_dedup.suffix_dedup(df, 1 << 16, with_bytes=False).collect()
    assert Counter(tuple(r) for r in out) == brute([tuple(r) for r in df.collect()])
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=60, max_size=400).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 40), st.integers(1, 3))
def test_sort(data, length, words):
    at = np.arange(len(data) - length)
    group = at % 2
    order, first = sort_prefixes(np.frombuffer(data + bytes(64), np.uint8), at, group, length, words)
    strings = [(int(group[k]), data[at[k] : at[k] + length]) for k in order]
    assert strings == sorted(strings)
    assert first.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]

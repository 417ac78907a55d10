"""Token counts against the library's own encoding of whole texts."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from surtscope.llm import token_counts
from surtscope.llm.queries import COUNTED_VOCABULARY

LIBRARY = Tokenizer.from_file(COUNTED_VOCABULARY)


def brute(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.TokenCounter(
        COUNTED_VOCABULARY, token_counts.whole_tokens(COUNTED_VOCABULARY), token_counts.special_strings(COUNTED_VOCABULARY)
    )


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "It's the dog's, they'LL we've I'm I'd"), (4, "It's the dog's, they'LL we've I'm I'd"),
    (5, "<|startoftext|>Hello<|endoftext|><|endoftext|>  World"), (6, "<|ENDOFTEXT|> <|endoftext |>"), (None, "Été µ ªº ½² ×÷ ß"),
    (7, "日本語 \U0001f389\U0001f1e9\U0001f1ea é ﬁ İstanbul Σς"), (8, "x" * 5000), (9, "word " * 2048), (10, "word " * 2049), (11, "12345 6.7"),
    (12, "a\x00b\x1c\x1d\x85\xa0c d　e"), (-1, "''s 'S 's't"), (13, "floccinaucinihilipilification " * 30),
]


def test_odd_rows(spark, rows):
    docs = rows("doc_id long, text string, n_bytes string, `a.b` int, n_tokens int", *((*d, "x", 1, 2) for d in ODD))
    found = token_counts.count_tokens(docs, COUNTED_VOCABULARY)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter((i, len((t or "").encode()), brute(t), brute(t) > 2048) for i, t in ODD)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert {r.over_limit for r in found.collect() if r.doc_id in (9, 10)} == {False, True}
    assert token_counts.count_tokens(docs.limit(0), COUNTED_VOCABULARY).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, COUNTED_VOCABULARY).collect()} == want


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(max_codepoint=0xFF), max_size=60))
def test_latin_texts(counter, text):
    assert counter.count(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_texts(counter, text):
    assert counter.count(text) == brute(text)


def test_every_latin_character_in_context(counter):
    for k in range(256):
        for text in (chr(k), f"a{chr(k)}b", f"1{chr(k)}{chr(k)} ", f"'{chr(k)}s"):
            assert counter.count(text) == brute(text), (k, text)


def test_whole_tokens_are_not_merged(counter):
    whole = token_counts.whole_tokens(COUNTED_VOCABULARY)
    assert len(whole) > 30_000
    words = [w for w in sorted(whole) if w.isascii() and w.isalpha()]
    fresh = token_counts.TokenCounter(COUNTED_VOCABULARY, whole, [])
    assert fresh.count(" ".join(words)) == len(words) and fresh.merged == 0
    text = " ".join(random.Random(1).choices(words, k=200)) + " qzxqzx"
    assert fresh.count(text) == brute(text) and fresh.merged == 1

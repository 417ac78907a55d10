"""Alignment of two tokenizers against interval overlaps of every pair of tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from surtscope.llm import token_align
from surtscope.llm.queries import ALIGNED_LEFT, ALIGNED_RIGHT

LEFT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LEFT.encode_special_tokens = True
RIGHT = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTE_OF = token_align.byte_symbols()


def left_bytes(k):
    return bytes(BYTE_OF[c] for c in LEFT.id_to_token(k))


def right_bytes(k):
    piece = RIGHT.id_to_piece(k)
    return bytes([int(piece[3:5], 16)]) if RIGHT.is_byte(k) else piece.replace("▁", " ").encode()


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute_text(text):
    """(a, b, groups, links) by looking at every pair of tokens."""
    a = LEFT.encode(" " + (text or ""), add_special_tokens=False).ids
    b = RIGHT.encode(text or "")
    parts_a, parts_b = [left_bytes(k) for k in a], [right_bytes(k) for k in b]
    body = b" " + (text or "").encode()
    if not text or b"".join(parts_a) != body or b"".join(parts_b) != body:
        return [], [], "", []
    spans_a, spans_b = spans(parts_a), spans(parts_b)
    cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    groups, last = [], 0
    for cut in cuts:
        one = [str(k) for k, (s, e) in zip(a, spans_a) if last <= s and e <= cut]
        two = [str(k) for k, (s, e) in zip(b, spans_b) if last <= s and e <= cut]
        groups.append(f"{','.join(one)}|{','.join(two)}")
        last = cut
    links = [(x, y) for x, (s, e) in zip(a, spans_a) for y, (t, f) in zip(b, spans_b) if s < f and t < e]
    return a, b, ";".join(groups), links


def brute(rows):
    found = [(i, *brute_text(t)) for i, t in rows]
    counts = Counter(p for *_, links in found for p in links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = Counter()
    for i, a, b, groups, links in found:
        best = sum(counts[p] == most[p[1]] for p in links)
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out[i, len(a), len(b), len(groups.split(";")) if groups else 0, len(links), best, sum(counts[p] for p in links), sha] += 1
    return out


ODD = [
    (1, None), (2, ""), (3, " "), (4, "The quick brown fox, isn't it?"), (4, "The quick brown fox, isn't it?"), (5, "a▁b"),
    (6, "<|endoftext|> and <s></s><unk> <0x41>"), (7, "  two  spaces\n\n\ttabs\r\n"), (None, "naïve café Über"), (8, "é 日本語 \U0001f389‍"),
    (9, "\x00\x01 nul"), (10, "1234567890 3.14159 $#@!{}[]"), (11, "x" * 700), (12, "Donaudampfschifffahrtsgesellschaft " * 40), (-1, "﻿bom 　wide"),
]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [1 << 17, 5, 0])
def test_odd_rows(spark, rows, head):
    """The same with all counts broadcast, a few of them, and none."""
    docs = rows("doc_id long, text string, row int, pairs string, `a.b` int", *((*d, 1, "x", 2) for d in ODD)).repartition(3)
    found = token_align.align_corpus(docs, ALIGNED_LEFT, ALIGNED_RIGHT, with_groups=False, head=head)
    assert found.columns == COLUMNS
    assert Counter(tuple(r) for r in found.collect()) == brute(ODD)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 3000]
    some = docs.where("coalesce(length(text), 0) < 3000")
    found = token_align.align_corpus(some, ALIGNED_LEFT, ALIGNED_RIGHT, with_groups=False)
    assert Counter(tuple(r) for r in found.collect()) == brute(short)


def test_groups_are_given_whole(spark, rows):
    docs = rows("doc_id long, text string", *ODD)
    found = token_align.align_corpus(docs, ALIGNED_LEFT, ALIGNED_RIGHT)
    assert Counter((r.doc_id, r.groups) for r in found.collect()) == Counter((i, brute_text(t)[2]) for i, t in ODD)


def test_empty_table(spark, rows):
    found = token_align.align_corpus(rows("doc_id long, text string"), ALIGNED_LEFT, ALIGNED_RIGHT, with_groups=False)
    assert found.columns == COLUMNS and found.collect() == []


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(1, n)), st.sets(st.integers(1, n)))))
def test_walk_of_any_ends(case):
    n, a, b = case
    ends_a, ends_b = sorted(a | {n}), sorted(b | {n})
    found = token_align.align(ends_a, ends_b)
    cuts = sorted(set(ends_a) & set(ends_b))
    assert found.n_groups == len(cuts)
    assert found.groups_a.tolist() == [sum(c < e for c in cuts) for e in ends_a]
    assert found.groups_b.tolist() == [sum(c < e for c in cuts) for e in ends_b]
    starts_a, starts_b = [0, *ends_a], [0, *ends_b]
    want = {(i, j) for i, e in enumerate(ends_a) for j, f in enumerate(ends_b) if starts_a[i] < f and starts_b[j] < e}
    links = list(zip(found.links_a.tolist(), found.links_b.tolist()))
    assert len(links) == len(want) and set(links) == want


def test_long_one_to_one_stretches_take_few_probes():
    class Counting(list):
        reads = 0

        def __getitem__(self, k):
            Counting.reads += 1
            return super().__getitem__(k)

    ends = Counting(range(1, 100_001))
    found = token_align.align(ends, list(ends))
    assert found.n_groups == len(found.links_a) == 100_000
    assert Counting.reads < 60


def test_latin_texts_take_the_same_ids_from_both_files():
    rng, letters = random.Random(4), [chr(k) for k in range(256)]
    texts = ["".join(rng.choices(letters, k=60)) for _ in range(300)] + ["".join(rng.choices("ab 'é\n\xa0\x85s1", k=80)) for _ in range(300)]
    ranked, exact = token_align.LeftEncoder(*ALIGNED_LEFT), token_align.LeftEncoder(ALIGNED_LEFT[0])
    assert ranked.encode(texts) == exact.encode(texts)

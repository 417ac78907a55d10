"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from surtscope.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) & set(c)
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


ODD = [
    (1, None), (2, ""), (3, " \t\0 -- "), (4, "The cat, the CAT and Émile's état"), (5, "cat the état"), (5, "cat the état"),
    (None, "cat the état"), (7, "cat the état"), (8, "the état cat"), (9, "É is not é, Ünder"), (10, "naïve naïve\0cat"),
    (11, "word " * 5000 + "cat"), (12, "lonely"), (13, "42 cats_42 cats"), (-3, "42 cats 42 CATS"), (14, "日本 cat 日本"),
]
ITEMS = [(1, "the cat"), (2, None), (3, ""), (4, "42 CATS cats!"), (5, "unknownword"), (6, "état É 日本"), (1, "lonely word"), (None, "naïve cat"), (4, "42 CATS cats!")]


@pytest.mark.parametrize("k,block", [(50, 4096), (2, 4096), (3, 2), (1, 1)])
def test_odd_rows(spark, rows, collect, k, block):
    docs = rows("doc_id long, text string, n long, hash string, item int, `a.b` int", *((*d, 1, "x", 2, 3) for d in ODD))
    items = rows("item_id long, text string, doc_id long", *((*i, 9) for i in ITEMS))
    found = lexical_search.search(docs, items, k, block_items=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in found.collect()) == brute(ODD, ITEMS, k)


def test_large_classes_and_random_texts(spark, rows):
    """A third of all rows is one bag; others share words in many ways."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    docs = [(i, "w1 w2 w1 w3 padding") for i in range(300)]
    docs += [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(300, 900)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for i in range(30)]
    found = lexical_search.search(rows("doc_id long, text string", *docs).repartition(7), rows("item_id long, text string", *items))
    assert Counter(tuple(r) for r in found.collect()) == brute(docs, items, 50)


def test_one_class_is_scored_once(spark, rows):
    docs = rows("doc_id long, text string", *((i, "the cat sat") for i in range(50)), *((i, "sat cat the") for i in range(50, 60)))
    kept = lexical_search._keyed(lexical_search.bags(docs, {b"cat": 0, b"sat": 1}), 60, 180)
    (only,) = lexical_search.classes_of(kept).collect()
    assert (only.first_id, only.members, only.terms, only.counts, only.m) == (0, 60, [0, 1], [1, 1], 100)


def test_empty_tables(spark, rows):
    docs, items = rows("doc_id long, text string", (1, "a b")), rows("item_id long, text string", (1, "a"))
    none_docs, none_items = docs.limit(0), items.limit(0)
    for d, i in ((none_docs, items), (docs, none_items), (none_docs, none_items), (docs, rows("item_id long, text string", (1, " ")))):
        assert lexical_search.search(d, i).collect() == []
    assert lexical_search.search(docs, none_items).dtypes == lexical_search.search(docs, items).dtypes


def test_a_term_that_every_document_holds_scores_nothing(spark, rows):
    docs = rows("doc_id long, text string", *((i, "same") for i in range(600)))
    assert lexical_search.search(docs, rows("item_id long, text string", (1, "same"))).count() == 0

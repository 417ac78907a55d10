"""Katz scores against a dictionary model, and sums of its distributions."""

import math
import re
import zlib
from collections import Counter

import pytest

from surtscope.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, "The cat sat on the mat The CAT"), (4, "the dog sat\ton the mat"), (4, "the dog sat\ton the mat"),
    (None, "unknown é É words"), (10, "the cat sat on a new thing"), (11, "a a a a a a a a b"), (12, "the the the cat"), (20, "cat the cat b a"),
    (17, "x " * 400), (33, "the cat é"), (35, "the"), (36, "zebra quagga the zebra"),
]


def tokens(text):
    return [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(text or "")] + [" "]


class Model:
    def __init__(self, rows):
        train = [tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
        self.c = Counter(w for t in train for w in t)
        self.n, self.v, self.texts = sum(self.c.values()), len(self.c), len(train)
        self.pairs = Counter(p for t in train for p in zip(["\t", *t], t))
        classes = [sum(1 for n in self.pairs.values() if n == r) for r in range(1, katz.K + 2)]
        self.d = [1.0, *katz.good_turing(classes)]

    def low(self, w):
        return (self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, h, w):
        count = self.texts if h == "\t" else self.c[h]
        if not count:
            return self.low(w)
        give = lambda n: (self.d[n] if n <= katz.K else 1.0) * n / (count + katz.SLACK)
        if self.pairs[h, w]:
            return give(self.pairs[h, w])
        after = [b for a, b in self.pairs if a == h]
        alpha = (1 - sum(give(self.pairs[h, b]) for b in after)) / (1 - sum(map(self.low, after)))
        return alpha * self.low(w)


@pytest.mark.parametrize("which", ["odd", "split", "given"])
def test_scores(spark, rows, which):
    if which == "given":
        df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    else:
        df = rows("doc_id long, text string, score double, block long", *((*r, 1.0, 1) for r in ODD))
    data = [(r.doc_id, r.text) for r in df.collect()]
    out = katz.score_texts(df, block_bytes=150 if which == "split" else 1 << 16, split=3 if which == "split" else 1 << 24).collect()
    model = Model(data)
    want = {}
    for i, t in data:
        ws = tokens(t)
        want[i, t] = (
            len(ws), sum(model.c[w] > 0 for w in ws), model.n, sum(math.log10(model.low(w)) for w in ws),
            sum(math.log10(model.p(h, w)) for h, w in zip(["\t", *ws], ws)),
        )
    left = sorted((str(i), *v) for (i, t), v in want.items() for _ in range(data.count((i, t))))
    right = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out)
    for a, b in zip(left, right, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5])


def test_every_distribution_sums_to_one():
    model = Model(ODD)
    for h in ["\t", "zzz", *model.c]:
        assert sum(model.p(h, w) for w in [*model.c, "unknown to all"]) == pytest.approx(1, abs=1e-12)


def test_empty_and_untrained(rows):
    df = rows("doc_id long, text string", *ODD)
    assert katz.score_texts(df.limit(0)).count() == 0
    held = katz.score_texts(df.where("doc_id = 33"), training=df.doc_id < 0).collect()
    assert held[0].train_tokens == 0 and held[0].score == pytest.approx(held[0].base_score)

"""Each stage against brute force on its own input."""

import re
from collections import Counter, defaultdict

import pytest

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline as pipeline
from test_near_texts import brute as near_copies
from test_secrets import brute as secrets_of
from test_text_operators import ODD

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(params=["odd", "given"])
def docs(spark, rows, request):
    if request.param == "given":
        return spark.read.parquet(f"{FOLDER}/documents.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return rows(schema, *((*r, None, "s", 1) for r in ODD))


def keyed(df):
    return Counter((r.doc_id, r.text or "") for r in df.collect())


def test_stages(spark, docs):
    data = [(r.doc_id, r.text or "") for r in docs.collect()]
    good = pipeline.keep_quality(spark, docs, FOLDER)
    assert good.columns == COLUMNS and keyed(good) <= keyed(docs)

    groups = defaultdict(set)
    for i, t in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].add((-len(t), i is None, i or 0, i, t))
    want = Counter(min(g)[3:] for g in groups.values())
    exact = pipeline.drop_exact(spark, docs, FOLDER)
    assert exact.columns == COLUMNS and keyed(exact) == want

    near = pipeline.drop_near(spark, exact, FOLDER)
    stay = {i for i, c in near_copies(list(want)) if i == c}
    assert {r.doc_id for r in near.collect()} == stay and near.columns == COLUMNS

    masked = pipeline.mask_secrets(spark, docs, FOLDER)
    assert masked.columns == COLUMNS and masked.count() == len(data)
    clean = Counter((i, t) for i, t in data if not secrets_of(t) and "eyJ" not in t and "PRIVATE" not in t)
    assert clean <= keyed(masked)
    assert all(len(r.text) == r.n_chars for r in masked.collect() if "[SECRET]" in r.text)

    pieces = pipeline.pack(spark, masked, FOLDER)
    assert {r.doc_id for r in pieces.collect()} == {i for i, _ in data}


def test_run_and_empty(spark):
    assert [name for name, _ in pipeline.STAGES] == [
        "quality_classifier", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing",
    ]
    out = pipeline.run(spark, FOLDER)
    assert out.count() > 0 and len(out.first().ids) % 4 == 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0

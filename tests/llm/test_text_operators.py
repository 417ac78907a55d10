"""Operators on documents against brute force on small and odd tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from surtscope.llm import byte_bpe, exact_dedup, packing, pu_quality, quality_rules, simhash
from surtscope.llm import queries as registered
from surtscope.llm.vocabulary import encoder

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    (1, "alpha beta gamma alpha beta gamma\nalpha\n\nalpha"),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "alpha  beta gamma alpha beta gamma\nalpha\nalpha "),
    (5, "alpha  beta gamma alpha beta gamma\nalpha\nalpha "),
    (None, "alpha beta"),
    (7, "Ünïcödé 日本語 words\u0085and spaces #tag <b> $5 & %"),
    (8, "the of and " * 40 + "unique words here 1 2 3"),
    (9, "x" * 5000),
    (10, "ab " * 3000),
    (11, "the quick brown fox " + " ".join(f"w{k}" for k in range(300))),
    (12, "the quick brown fox " + " ".join(f"w{k}" for k in range(299)) + " changed"),
]


@pytest.fixture
def odd(rows):
    """Odd rows in a frame whose other columns have clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, fp long"
    return rows(schema, *((*r, None, "s", 1, 0.0, False, 1) for r in ODD))


@pytest.fixture
def none(odd):
    return odd.limit(0)


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def brute_quality(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for k, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


@pytest.mark.parametrize("which", ["odd", "given"])
def test_quality_rules(spark, odd, which):
    df = odd if which == "odd" else documents(spark)
    out = quality_rules.quality_report(df).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((i, *brute_quality(t)) for i, t in pairs(df))
    assert not any(r.kept and r.base_failed for r in out)


def test_quality_rules_keep_long_texts_and_other_scripts(spark, rows):
    def text(words, n):
        return " ".join(f"{words[k % len(words)]}{k}" if k % 3 else words[k * 31 % len(words)] for k in range(n))

    latin, russian = ["the", "house", "garden", "of", "stone"], ["дом", "сад", "улица", "книга", "вечер"]
    df = rows("doc_id long, text string", (1, text(latin, 196_000)), (2, text(latin, 240_000)), (3, text(russian, 600)), (4, text(latin[1:3], 600)))
    found = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.quality_report(df).collect()}
    assert found == {1: (False, True), 2: (False, True), 3: (False, True), 4: (False, False)}


def test_quality_rules_keep_clean_text_and_stay_native(spark):
    df = documents(spark).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    report = quality_rules.quality_report(df.where("quality = 1"))
    clean = report.where("not base_failed")
    assert clean.where("kept").count() >= 0.97 * clean.count()
    plan = quality_rules.quality_report(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i))
    out = Counter()
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best = min(groups[key])
        sha = hashlib.sha256(key.encode()).hexdigest()
        out[i, best[2], len(groups[key]), (-len(t), i is None, i) == best, sha] += 1
    return out


@pytest.mark.parametrize("which", ["odd", "given", "deep"])
def test_exact_dedup(spark, odd, which):
    df = odd if which == "odd" else documents(spark)
    out = exact_dedup.exact_dedup(df, node_records=1 if which == "deep" else 10**6).collect()
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out)
    assert got == brute_exact(pairs(df))


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    values = list({f for _, f in prints})
    parent = {f: f for f in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(values):
        for b in values[:k]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return Counter((i, f"{f:016x}", least.get(root(f))) for i, f in prints)


@pytest.mark.parametrize("which", ["odd", "given"])
def test_near_groups(spark, odd, which):
    df = odd if which == "odd" else documents(spark)
    out = simhash.near_groups(df).collect()
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in out)
    assert got == brute_components([(i, brute_fingerprint(t)) for i, t in pairs(df)])


def test_golay_code():
    code = simhash.Golay()
    words = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    near = code.indices(words)
    weight = code.weight[code.syndrome(words)]
    assert weight.max() <= 3 and (np.sort(code.four[code.weight == 3], axis=1) > 0).all()
    for bit in range(23):
        other = code.indices(words ^ (1 << bit))
        shared = ((near[:, :, None] == other[:, None, :]) & (near[:, :, None] >= 0)).any(axis=(1, 2))
        assert shared.all()


@pytest.mark.parametrize("cell", [4096, 3])
def test_links_lose_no_component(spark, cell):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 30)
    prints = {int(c) for c in centres}
    for c in centres:
        x = int(c)
        for _ in range(20):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            prints.add(x if rng.random() < 0.8 else x ^ int(rng.integers(0, 1 << 63)))
    rows = [(k, int(np.uint64(p).view(np.int64))) for k, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df.select("fp"), cell)).collect()}
    signed = dict(rows)
    want = defaultdict(set)
    for i, _, c in brute_components([(i, p % (1 << 64)) for i, p in signed.items()]):
        want[c].add(i)
    have = defaultdict(set)
    for i, p in rows:
        have[roots.get(p, p)].add(i)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


CODER = byte_bpe.codec(registered.CODING_RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabehtn  \n\t'sré日本語1🙂\u0085\u001c !?"), max_size=200))
def test_bpe_like_the_library(text):
    ids = np.frombuffer(CODER.encode(text), "<u4").tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODER.decode(CODER.encode(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdehinorstu"), min_size=1, max_size=300), st.integers(1, 9))
def test_bpe_tree_is_the_flat_merge(text, leaf):
    coder = byte_bpe.ByteBPE(CODER.ranks, public_tokenizers.PATTERN, leaf, 1)
    assert coder.tree(text.encode()) == coder.merge(text.encode())


@pytest.mark.parametrize("which", ["odd", "given"])
def test_bpe_query(spark, odd, which):
    df = odd if which == "odd" else documents(spark)
    out = byte_bpe.digest_texts(df, registered.CODING_RANKS, public_tokenizers.PATTERN).collect()
    want = Counter()
    for i, t in pairs(df):
        ids = LIBRARY.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in out) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab  \n\t'sré日1\u0085\u001c !\0", "<|endoftext|>"]), max_size=60))
def test_chunked_ids_like_the_library(parts):
    text = "".join(parts)
    whole = Tokenizer.from_file(registered.PACKING_VOCABULARY).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(registered.PACKING_VOCABULARY).encode(text), "<u4").tolist() == whole
    assert np.frombuffer(encoder(*registered.PACKING_ENCODER).encode(text), "<u4").tolist() == whole


LIBRARY_TOKENIZER = Tokenizer.from_file(registered.PACKING_VOCABULARY)


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(max_codepoint=255), max_size=40))
def test_latin_ids_like_the_library(text):
    whole = LIBRARY_TOKENIZER.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(*registered.PACKING_ENCODER).encode(text), "<u4").tolist() == whole


@pytest.mark.parametrize("which", ["odd", "given"])
def test_packing(spark, odd, which):
    df = odd if which == "odd" else documents(spark)
    out = packing.pack_texts(df, *registered.PACKING_ENCODER).collect()
    library = Tokenizer.from_file(registered.PACKING_VOCABULARY)
    want = Counter((i, tuple(library.encode(t, add_special_tokens=False).ids) + (0,)) for i, t in pairs(df))
    held, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        ids = bytes(r.ids)
        assert len(ids) == 4 * r.length and zlib.crc32(ids) == r.ids_crc32 and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        held[r.doc_id].append((r.start, ids, r.doc_tokens))
    for pieces in sequences.values():
        pieces.sort()
        ends = [0, *np.cumsum([n for _, n in pieces]).tolist()]
        assert [o for o, _ in pieces] == ends[:-1] and ends[-1] <= 1024
        assert ends[-1] == 1024 or len(pieces) == 64 or ends[-1] & (ends[-1] - 1) == 0
    single = {i for (i, _), n in want.items() if n == 1 and sum(k[0] == i for k in want) == 1}
    for (i, ids), _ in want.items():
        if i in single:
            joined = b"".join(x for _, x, _ in sorted(held[i]))
            assert np.frombuffer(joined, "<u4").tolist() == list(ids) and held[i][0][2] == len(ids)
    assert sum(len(x) for v in held.values() for _, x, _ in v) == sum(4 * len(k[1]) * n for k, n in want.items())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), max_size=60))
def test_packer_keeps_every_limit(examples):
    limits = packing.Limits(tokens=100, segments=4, loss=60)
    packer = packing.VectorPacker(limits, pool=8)
    pieces = []
    for k, (n, loss) in enumerate(examples):
        pieces += packer.add(k, n, min(n, loss))
    pieces += packer.finish()
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence].append(p)
    for group in by.values():
        assert len(group) <= limits.segments and sum(p.length for p in group) <= limits.tokens
        loss = [packing._loss_in(p.start, p.length, examples[p.item][0] - min(examples[p.item])) for p in group]
        assert sum(loss) <= limits.loss
    spans = defaultdict(list)
    for p in pieces:
        spans[p.item].append((p.start, p.start + p.length))
    for k, (n, _) in enumerate(examples):
        cuts = sorted(spans[k])
        assert [a for a, _ in cuts] == [0, *(b for _, b in cuts)][: len(cuts)] and (cuts[-1][1] if cuts else 0) == n


def test_pack_examples_frame(rows):
    df = rows("example_id long, n_tokens int, n_loss int, start int", (1, 700, 100, 9), (2, None, 5, 9), (3, 2000, 0, 9), (3, 40, 40, 9))
    out = packing.pack_examples(df).collect()
    assert sum(r.length for r in out) == 2740


def test_quality_classifier(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = pu_quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.96 * len(out)


def test_quality_classifier_on_odd_rows(odd, none, rows):
    labels = rows("doc_id long, quality int, toxic int, text string", (8, 1, 0, "x"), (11, 1, 0, "x"), (2, 0, None, "x"), (None, None, 1, "x"))
    out = pu_quality.quality_scores(odd, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.held_out for r in out if r.doc_id} == {True, False}
    assert {r.score for r in pu_quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def test_empty_tables(none, rows):
    labels = rows("doc_id long, quality int", (1, 1))
    assert quality_rules.quality_report(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert packing.pack_texts(none, registered.PACKING_VOCABULARY).count() == 0
    assert byte_bpe.encode_texts(none, registered.CODING_RANKS, public_tokenizers.PATTERN).count() == 0
    assert pu_quality.quality_scores(none, labels).count() == 0

"""Near copies against brute force: Jaccard of five-word shingles, all pairs."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from surtscope.llm import near_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return Counter((i, least.get(r)) for (i, _), r in zip(rows, root))


def altered():
    """Texts of 200 words, and copies with scattered words changed."""
    pick, rows = random.Random(5), []
    for k in range(40):
        words = [f"w{pick.randrange(5000)}" for _ in range(200)]
        rows.append((10 * k, " ".join(words)))
        for j, changes in enumerate((1, 2, 3, 4, 6, 12), 1):
            copy = list(words)
            for at in pick.sample(range(200), changes):
                copy[at] = f"new{at}"
            rows.append((10 * k + j, " ".join(copy)))
    return rows


ODD = [
    (1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "x y z x y z"), (None, "x y z x y Z"),
    (9, "one two three four five six seven eight nine"), (8, "one two three four five six seven eight"), (9, "alone"),
    (11, "one two three four five six seven"),
]


@pytest.mark.parametrize("which", ["odd", "altered", "given"])
def test_near_texts(spark, rows, which):
    if which == "given":
        df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    else:
        df = rows("doc_id long, text string", *(ODD if which == "odd" else altered()))
    data = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(data)
    assert Counter(map(tuple, near_texts.near_texts(df).collect())) == want
    kept = pipeline.drop_near(spark, df, "")
    stay = {i for i, c in want if i == c}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in data if i in stay)


def templated(pairs, seed=3):
    """Pairs of near copies at 0.823 among texts of one template that are 0.782 to each other."""
    pick = random.Random(seed)
    template, rows = [f"t{k}" for k in range(200)], []

    def changed(words, places, tag):
        out = list(words)
        for at in places:
            out[at] = f"{tag}_{at}"
        return out

    for k in range(pairs):
        base = changed(template, [k * 7 % 50, 60 + k * 11 % 50, 120 + k * 13 % 70], f"p{k}")
        for j, at in enumerate(pick.sample(range(6, 190, 10), 4)):
            if j < 2:
                rows.append((2 * k + j, " ".join(changed(base, [at, (at + 97) % 200], f"c{k}_{j}"))))
    return rows


def jaccards(rows):
    sets = [grams(t) for _, t in rows]
    return lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])


def test_templated_texts_lose_no_link(spark, rows):
    """Boilerplate with few words of its own, against all pairs."""
    data = templated(120)
    found = near_texts.near_texts(rows("doc_id long, text string", *data))
    assert Counter(map(tuple, found.collect())) == brute(data)


def hub(copies):
    """One base and copies of it that are close to the base but mostly not to each other."""
    pick, out = random.Random(8), []
    words = [f"w{pick.randrange(5000)}" for _ in range(200)]
    for i in range(copies):
        copy = list(words)
        for at in pick.sample(range(5, 195), 3):
            copy[at] = f"n{i}_{at}"
        out.append((i, " ".join(copy)))
    out.insert(copies // 2, (copies + 1, " ".join(words)))
    return out


def test_a_large_group_costs_about_a_pair_for_each_text(spark, rows, monkeypatch):
    data = hub(400)
    of = jaccards(data)
    assert sum(of(i, j) < 0.8 for i in range(40) for j in range(i)) > 300
    compared = []
    similar = near_texts._similar

    def watched(pairs, *rest):
        compared.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(near_texts, "_similar", watched)
    found = near_texts.near_texts(rows("doc_id long, text string", *data)).collect()
    assert {r.component_id for r in found} == {0} and len(found) == len(data)
    assert sum(compared) < 4 * len(data)


def test_similar_sets_share_a_key_of_their_prefixes():
    """The filter's promise for random sets around the threshold, in any order."""
    pick = random.Random(6)
    for _ in range(3000):
        n = pick.randrange(1, 60)
        one = pick.sample(range(200), n)
        two = pick.sample(one, pick.randrange(int(0.75 * n), n + 1)) + pick.sample(range(200, 260), pick.randrange(0, 1 + n // 4))
        a, b = sorted((sorted(set(one)), sorted(set(two))), key=len)
        both = len(set(a) & set(b))
        if not b or 5 * both < 4 * (len(a) + len(b) - both):
            continue
        short, long = near_texts.prefix_sizes(len(a), 0.8)[0], near_texts.prefix_sizes(len(b), 0.8)[1]
        assert set(a[:short]) & set(b[:long])

"""Counting, pivot, top-k, quantile and reconciliation helpers against brute force."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surtscope.functions import measures as m
from surtscope.operators import quantiles as quant
from surtscope.operators import reconcile as rec
from surtscope.operators import rollups as roll

SCHEMA = "base_domain string, crawl_year string, label string, size bigint"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    out = []
    for _ in range(3000):
        domain = rng.choices(["hot.gov", "a.gov", "b.gov"], [8, 1, 1])[0]
        out.append((domain, rng.choice(["2004", "2008", "2012"]), rng.choice("pqrstu") * rng.randint(1, 3), rng.randint(0, 5_000_000)))
    return out


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_year_pivot_counts_and_total(frame, data):
    wide = roll.year_pivot(frame, ["label"], ["2004", "2008", "2012", "2016"])
    want = Counter((r[2], r[1]) for r in data)
    for r in wide.collect():
        years = [want[(r["label"], y)] for y in ("2004", "2008", "2012", "2016")]
        assert [r["2004"], r["2008"], r["2012"], r["2016"]] == years
        assert r["total"] == sum(years)


def test_compact_frame_gives_the_same_report(frame, collect):
    small = roll.compact(frame, ["base_domain", "crawl_year", "label"])
    assert collect(roll.year_pivot(small, ["label"])) == collect(roll.year_pivot(frame, ["label"]))
    small = roll.compact(small, ["crawl_year", "label"])
    assert collect(roll.count_by(small, ["label"])) == collect(roll.count_by(frame, ["label"]))


def test_pivot_values_fills_missing_cells(rows, collect):
    long = rows("k string, y string, n bigint", ("a", "1", 5), ("b", "2", 7))
    assert collect(roll.pivot_values(long, ["k"], "y", ["1", "2", "3"], "n")) == [
        ("a", 5, 0, 0),
        ("b", 0, 7, 0),
    ]


def test_share_of_total(frame, data):
    shares = roll.with_share(roll.count_by(frame, ["label"]), "n").collect()
    counts = Counter(r[2] for r in data)
    assert {r.label: r.pct for r in shares} == {
        k: round(100.0 * v / len(data), 2) for k, v in counts.items()
    }


def test_row_percentages(rows, collect):
    wide = rows("k string, a bigint, b bigint", ("x", 1, 3), ("y", 0, 0))
    assert collect(roll.row_percentages(wide, ["a", "b"], 1)) == [("x", 25.0, 75.0), ("y", None, None)]


@pytest.mark.parametrize("within", [[], ["base_domain"]])
def test_top_k_with_rest_keeps_every_capture(frame, data, within):
    totals = roll.count_by(frame, [*within, "label"], "total")
    got = roll.top_k_with_rest(totals, "label", 4, within=within).collect()
    assert sum(r.total for r in got) == len(data)
    groups = Counter(r["base_domain"] if within else "" for r in got)
    assert set(groups.values()) == {5}
    for g in groups:
        mine = [r for r in data if not within or r[0] == g]
        best = sorted(Counter(r[2] for r in mine).items(), key=lambda kv: (-kv[1], kv[0]))[:4]
        have = {r.label: r.total for r in got if (r["base_domain"] if within else "") == g}
        assert {k: v for k, v in have.items() if k != "(other)"} == dict(best)
        assert have["(other)"] == len(mine) - sum(v for _, v in best)


def test_rest_row_is_zero_when_nothing_is_left(rows, collect):
    totals = rows("label string, total bigint", ("a", 3))
    assert collect(roll.top_k_with_rest(totals, "label", 5)) == [("(other)", 0), ("a", 3)]


@pytest.mark.parametrize("within", [[], ["base_domain"]])
def test_tail_is_renamed(frame, data, within):
    counts = roll.count_by(frame, [*within, "crawl_year", "label"])
    got = roll.tail_as(counts, "label", 3, within=within)
    assert got.agg(F.sum("n")).first()[0] == len(data)
    for g in {r[0] for r in data} if within else {None}:
        mine = [r for r in data if g is None or r[0] == g]
        best = sorted(Counter(r[2] for r in mine).items(), key=lambda kv: (-kv[1], kv[0]))[:3]
        part = got if g is None else got.where(F.col("base_domain") == g)
        assert {r.label for r in part.collect()} == {k for k, _ in best} | {"other"}


def test_top_k_per_group_limits_before_the_shuffle(frame):
    counts = roll.count_by(frame, ["base_domain", "label"])
    top = roll.top_k(counts, 2, [F.col("n").desc(), F.col("label")], ["base_domain"])
    assert top.groupBy("base_domain").count().where("count != 2").isEmpty()
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_year_totals(rows, collect):
    long = rows("d string, y string, n bigint", ("a", "1", 2), ("a", "2", 3), ("b", "1", 4))
    assert collect(roll.with_year_totals(long, ["d"], "y", "n")) == [
        ("a", "1", 2),
        ("a", "2", 3),
        ("a", "ALL", 5),
        ("b", "1", 4),
        ("b", "ALL", 4),
    ]


def test_distinct_per_column_ignores_nulls(rows):
    df = rows("a string, b int", ("x", 1), ("x", 2), (None, 2), ("", None))
    assert tuple(roll.distinct_per_column(df).first()) == (2, 2)
    assert tuple(roll.distinct_per_column(df.limit(0)).first()) == (0, 0)


def test_quantiles_equal_percentile(frame, collect):
    keys, wanted = ["base_domain"], {"med": 0.5, "p95": 0.95, "lo": 0.0, "hi": 1.0}
    values = quant.blocked(frame, keys, "size")
    got = collect(quant.quantiles(values, keys, wanted))
    want = collect(
        frame.groupBy("base_domain").agg(
            F.median("size"), F.percentile("size", 0.95), F.min("size").cast("double"), F.max("size").cast("double")
        )
    )
    assert [r[0] for r in got] == [r[0] for r in want]
    for g, w in zip(got, want):
        assert g[1:] == pytest.approx(w[1:], rel=1e-12)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), min_size=1, max_size=30), st.sampled_from([0.1, 0.5, 0.95]))
def test_quantiles_of_any_integers(spark, values, p):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v bigint")
    got = quant.quantiles(quant.blocked(df, ["k"], "v"), ["k"], {"q": p}).first().q
    s = sorted(values)
    pos = p * (len(s) - 1)
    low = int(pos)
    high = min(low + 1, len(s) - 1)
    assert got == pytest.approx(s[low] + (s[high] - s[low]) * (pos - low), rel=1e-9, abs=1e-3)


def test_count_diff(rows, collect):
    a = rows("k string, l bigint", ("x", 1), ("y", 2))
    b = rows("k string, r bigint", ("y", 5), ("z", 6))
    assert collect(rec.count_diff(a, b, ["k"], "l", "r")) == [("x", 1, 0, -1), ("y", 2, 5, 3), ("z", 0, 6, 6)]
    kept = collect(rec.count_diff(a, b, ["k"], "l", "r", missing_as_zero=False))
    assert kept == [("x", 1, None, None), ("y", 2, 5, 3), ("z", None, 6, None)]
    order = [r.k for r in rec.largest_gap_first(rec.count_diff(a, b, ["k"], "l", "r"), "k").collect()]
    assert order == ["z", "y", "x"]


def test_absent_rows_with_null_keys(rows, collect):
    new = rows("a string, b string, v int", ("x", None, 1), ("y", "q", 2), (None, "z", 3))
    old = rows("a string, b string", ("x", None), (None, "other"))
    assert collect(rec.absent_from(new, old, ["a", "b"])) == [("y", "q", 2), (None, "z", 3)]
    assert collect(rec.with_keys_of(old, new, ["a", "b"])) == [("x", None)]


def test_rounding_and_casts(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (2.7,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(m.to_bigint(F.col("x"))).collect()] == [2, 4, 3, -2]
    assert [r[0] for r in df.select(m.rint_digits(F.col("x") / 10, 1)).collect()] == [0.2, 0.4, 0.3, -0.2]


def test_labels(rows):
    df = rows("s int, n bigint", (204, 1), (302, 2), (404, 5), (503, 6), (99, 20), (None, 21))
    got = df.select(m.status_class("s"), m.occurrence_bucket(F.col("n"))).collect()
    assert [r[0] for r in got] == ["2xx", "3xx", "4xx", "5xx", "other", "other"]
    assert [r[1] for r in got] == ["1 (seen once)", "2-5", "2-5", "6-20", "6-20", "20+"]


def test_composite_is_null_with_a_null_part(rows):
    df = rows("a string, b string", ("x", "y"), ("x", None))
    assert [r[0] for r in df.select(m.composite(F.col("a"), F.col("b"))).collect()] == ["x|y", None]


def test_total_counts_years_that_are_not_listed(rows):
    df = rows("k string, crawl_year string", ("a", "2020"), ("a", "2031"), ("a", None), ("b", "2031"))
    out = {r.k: (r["2020"], r.total) for r in roll.year_pivot(df, ["k"], ["2020"]).collect()}
    assert out == {"a": (1, 3), "b": (0, 1)}


def test_years_come_from_the_captures(rows):
    """A year outside the usual list counts; the newest pair is the one a group has."""
    from surtscope.plans import dedup, structure

    data = [("gov,ed)/a", "a", "2004"), ("gov,ed)/a", "a", "2012"), ("gov,ed)/b", "b", "2012"), ("gov,ed)/a", "a", "2030"),
            ("gov,ed)/c", "c", "2030"), ("gov,nih)/a", "a", "2008"), ("gov,nih)/b", "b", "2012"), ("gov,doi)/z", "z", "2012")]
    df = rows("surtkey string, base_domain string, surtpath_1 string, crawl_year string",
              *[(k, k[4:].split(")")[0] + ".gov", p, y) for k, p, y in data])
    churn = {(r.base_domain, r.category): r["count"] for r in structure.path_churn(df, within=["base_domain"]).collect()}
    assert churn == {
        ("ed.gov", "Only in 2012"): 1, ("ed.gov", "In both"): 1, ("ed.gov", "Only in 2030"): 1,
        ("nih.gov", "Only in 2008"): 1, ("nih.gov", "In both"): 0, ("nih.gov", "Only in 2012"): 1,
    }
    periods = structure.path_churn_all_periods(df).collect()
    assert [r.period for r in periods] == ["2004→2008", "2008→2012", "2012→2030"]
    overlap = {r.domain: r for r in dedup.year_overlap(df, ["ed.gov", "nih.gov"]).collect()}
    assert (overlap["ed.gov"]["1 year(s)"], overlap["ed.gov"]["3 year(s)"], overlap["ed.gov"].total_unique_surts) == (2, 1, 3)
    assert structure.path_churn(df.where("crawl_year = '2004'")).count() == 0


def test_records_of_one_moment_are_two_captures(rows):
    from surtscope.operators.reconcile import absent_from
    from surtscope.tables.store import CAPTURE_KEY

    schema = "surtkey string, fetch_timestamp string, url string, warc_filename string, offset long"
    old = rows(schema, ("k", "t", "u", "w", 1), ("k", "t", "u", None, 2))
    new = rows(schema, ("k", "t", "u", "w", 1), ("k", "t", "u", "w", 9), ("k", "t", "u", None, 2))
    assert [r.offset for r in absent_from(new, old, CAPTURE_KEY).collect()] == [9]

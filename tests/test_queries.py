"""Every registered query: same rows as its SQL, and a plan fit for large tables."""

import re

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from surtscope.plans import dedup, overview, structure
from surtscope import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_all_reports_are_registered():
    numbers = {int(m.group(1)) for m in (re.match(r"q(\d+)_", n) for n in QUERIES) if m}
    assert numbers == set(range(1, 75))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("q")))
def test_plan(spark, name):
    """No nested-loop join, no Python in the row path, no window over a whole frame."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan
    for line in plan.splitlines():
        if "Window [" in line:
            assert "windowspecdefinition(" in line and not re.search(r"windowspecdefinition\(specified", line)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_matrix_totals(spark):
    for r in QUERIES["q31_domain_year_matrix"](spark, FOLDER).collect():
        for s in ("parquet", "CDXJ"):
            assert r[f"ALL {s}"] == sum(r[f"{y} {s}"] for y in catalog.YEARS)


def test_overlap_total_is_the_number_of_keys(spark):
    captures = catalog.Archive(spark, FOLDER).captures()
    for r in dedup.year_overlap(captures, catalog.DOMAINS).collect():
        keys = captures.where(captures.base_domain == r.domain).select("surtkey").distinct().count()
        assert r.total_unique_surts == keys


def test_churn_adds_up(spark):
    captures = catalog.Archive(spark, FOLDER).captures()
    churn = {r.category: r["count"] for r in structure.path_churn(captures).collect()}
    seen = structure.path_prefixes(captures, 1)
    assert churn["Only in 2020"] + churn["In both"] == seen.where("`2020` > 0").count()
    assert churn["Only in 2024"] + churn["In both"] == seen.where("`2024` > 0").count()


def test_reports_without_stored_columns(spark, collect):
    """Frames that lack the derived columns give the same reports."""
    stored = catalog.Archive(spark, FOLDER).captures()
    bare = stored.drop("reg_domain", "sub_full", "ext", "filename", "pdf_name", "depth", "base_domain")
    for report in (
        structure.extensions,
        structure.filenames,
        structure.pdf_names,
        structure.path_depth,
        structure.clean_urls,
        lambda c: overview.domain_summary(c, "full"),
        lambda c: overview.top_subdomains(c, catalog.DOMAINS),
        lambda c: dedup.duplication(c, catalog.DOMAINS),
    ):
        assert collect(report(bare)) == collect(report(stored))
    unmigrated = bare.drop("surthost", *[f"surthost_seg_{i}" for i in range(6)])
    assert collect(overview.domain_summary(unmigrated)) == collect(overview.domain_summary(stored, "full"))


def test_url_structure_report_has_every_frame(spark):
    a = catalog.Archive(spark, FOLDER)
    frames = structure.url_structure_report(a.captures(), base=a.report_base())
    assert sorted(frames) == sorted(structure.REPORT_FRAMES)
    for df in frames.values():
        assert df.columns[0] == "base_domain"
        assert not df.limit(1).isEmpty()

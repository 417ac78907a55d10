"""Loading Parquet indexes into a labelled table whose columns may grow."""

import datetime

import pytest
from pyspark.sql import types as T

from surtscope import catalog
from surtscope.plans import reconcile
from surtscope.tables import index_table, loads, store

TARGETS = ("doi.gov", "ed.gov")
YEARS = ("2004", "2008", "2012")


@pytest.fixture
def folders(spark, rows, tmp_path):
    """Three crawls whose files differ in columns, order, case and types."""
    made = {
        "2004": rows("url_surtkey string, fetch_status int, size float", ("gov,doi)/", 200, 1.5), ("gov,x)/", 404, 2.5), (None, 1, None)),
        "2008": rows("Size double, subset string, fetch_status long, url_surtkey string", (3.5, "warc", 1 << 40, "gov,ed)/"), (4.5, "cdx", 7, "gov,doi,a)/")),
        "2012": rows("url_surtkey string, crawl_year int, base_domain string", ("gov,doi:80)/", 1, "wrong")),
    }
    for year, df in made.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"CRAWL-{year}"))
    return {y: str(tmp_path / f"CRAWL-{y}") for y in YEARS}


WANT = {
    ("gov,doi)/", 200, 1.5, None, "2004", "doi.gov"),
    ("gov,x)/", 404, 2.5, None, "2004", "other"),
    (None, 1, None, None, "2004", None),
    ("gov,ed)/", 1 << 40, 3.5, "warc", "2008", "ed.gov"),
    ("gov,doi,a)/", 7, 4.5, "cdx", "2008", "doi.gov"),
    ("gov,doi:80)/", None, None, None, "2012", "doi.gov"),
}


def found(spark, path):
    rows = index_table.read(spark, path).select("url_surtkey", "fetch_status", "size", "subset", "crawl_year", "base_domain").collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def test_columns_grow_in_any_order(spark, folders, tmp_path):
    whole = str(tmp_path / "whole")
    assert index_table.load_years(spark, folders, whole, "all", TARGETS, YEARS) == {"2004": 3, "2008": 2, "2012": 1}
    assert found(spark, whole) == WANT
    for order in (YEARS, ("2012", "2008", "2004")):
        path = str(tmp_path / f"step-{order[0]}")
        for year in order:
            index_table.load_years(spark, folders, path, [year], TARGETS, YEARS)
        assert found(spark, path) == WANT
        kinds = {c.lower(): t for c, t in index_table.read(spark, path).dtypes}
        assert (kinds["fetch_status"], kinds["size"], kinds["crawl_year"]) == ("bigint", "double", "string")


def test_replaced_years_and_absent_years(spark, folders, tmp_path):
    path = str(tmp_path / "t")
    index_table.load_years(spark, folders, path, "all", TARGETS, YEARS)
    for _ in range(2):
        assert index_table.load_years(spark, folders, path, ["2008"], TARGETS, YEARS, mode="replace") == {"2008": 2}
    assert found(spark, path) == WANT
    with pytest.warns(UserWarning, match="2016"):
        again = index_table.load_years(spark, folders, path, ["2004", "2016"], TARGETS, [*YEARS, "2016"])
    assert again == {"2004": 3} and index_table.read(spark, path).count() == 9
    with pytest.raises(FileNotFoundError):
        index_table.load_years(spark, folders, path, ["2016"], TARGETS, ["2016"])
    with pytest.raises(ValueError):
        index_table.load_years(spark, folders, path, ["1999"], TARGETS, YEARS)
    with pytest.raises(FileNotFoundError):
        index_table.read(spark, str(tmp_path / "none"))


def test_a_type_that_does_not_fit_leaves_the_table(spark, rows, folders, tmp_path):
    path = str(tmp_path / "t")
    index_table.load_years(spark, folders, path, "all", TARGETS, YEARS)
    bad = tmp_path / "bad"
    rows("url_surtkey string, fetch_status string", ("gov,doi)/", "x")).write.parquet(str(bad))
    with pytest.raises(index_table.TypeConflict, match="fetch_status"):
        index_table.load_years(spark, {"2004": str(bad)}, path, ["2004"], TARGETS, YEARS)
    assert found(spark, path) == WANT


def test_a_load_that_dies_brings_no_columns(spark, folders, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    index_table.load_years(spark, folders, path, ["2004"], TARGETS, YEARS)
    with monkeypatch.context() as m:
        m.setattr(loads, "publish", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index_table.load_years(spark, folders, path, ["2008"], TARGETS, YEARS)
    assert index_table.read(spark, path).columns == ["url_surtkey", "fetch_status", "size", "crawl_year", "base_domain"]
    index_table.load_years(spark, folders, path, ["2008", "2012"], TARGETS, YEARS)
    assert found(spark, path) == WANT


def test_widening():
    wider = index_table.wider
    assert wider("c", T.IntegerType(), T.LongType()) == wider("c", T.LongType(), T.ByteType()) == T.LongType()
    assert wider("c", T.FloatType(), T.DoubleType()) == wider("c", T.DoubleType(), T.IntegerType()) == T.DoubleType()
    assert wider("c", T.StringType(), T.IntegerType()) == T.StringType()
    for pair in ((T.LongType(), T.DoubleType()), (T.IntegerType(), T.StringType()), (T.DoubleType(), T.LongType())):
        with pytest.raises(index_table.TypeConflict):
            wider("c", *pair)


def test_dates_become_times(spark, rows, tmp_path):
    day, time = datetime.date(2004, 1, 2), datetime.datetime(2008, 1, 2, 3)
    rows("url_surtkey string, d date", ("gov,doi)/", day)).write.parquet(str(tmp_path / "a"))
    rows("url_surtkey string, d timestamp_ntz", ("gov,doi)/", time)).write.parquet(str(tmp_path / "b"))
    index_table.load_years(spark, {"2004": str(tmp_path / "a")}, str(tmp_path / "t"), ["2004"], TARGETS, YEARS)
    index_table.load_years(spark, {"2008": str(tmp_path / "b")}, str(tmp_path / "t"), ["2008"], TARGETS, YEARS)
    assert {r.d for r in index_table.read(spark, str(tmp_path / "t")).collect()} == {datetime.datetime(2004, 1, 2), time}


FOLDER = "/root/testdata/sf0.001"
INDEX_SIDE = {
    "q26": lambda s, c, p: reconcile.domain_diff(c, p, catalog.DOMAINS),
    "q27": lambda s, c, p: reconcile.domain_year_gaps(c, p, catalog.DOMAINS),
    "q28": lambda s, c, p: reconcile.subset_breakdown(p, catalog.DOMAINS),
    "q29": lambda s, c, p: reconcile.duplicate_rows(c, p, catalog.DOMAINS),
    "q30": lambda s, c, p: reconcile.outside_targets(p, catalog.DOMAINS),
    "q31": lambda s, c, p: reconcile.domain_year_matrix(s, c, p, catalog.DOMAINS, catalog.YEARS, catalog.SUFFIX),
    "q32": lambda s, c, p: reconcile.split_report(s, c, p, catalog.DOMAINS, catalog.SUFFIX),
}


@pytest.mark.parametrize("name", INDEX_SIDE)
def test_comparisons_skip_folders_of_other_domains(spark, name):
    """Every scan of the index filters on its stored label, and no key is matched again."""
    a = catalog.Archive(spark, FOLDER)
    plan = INDEX_SIDE[name](spark, a.captures(), a.index())._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan parquet")[1:] if "/index-table-" in x]
    assert scans
    for scan in scans:
        filters = scan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
        assert "base_domain" in filters, filters
    assert "regexp_extract" not in plan and "RLIKE" not in plan

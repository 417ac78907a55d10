import pytest
from pyspark.sql import functions as F

from surtscope.operators import domains as dom

KEYS = [
    ("gov,doi)/", "doi.gov"),
    ("gov,doi:8080)/", "doi.gov"),
    ("gov,doi,data)/x", "doi.gov"),
    ("gov,doi,data:81)/x", "doi.gov"),
    ("gov,doix)/", None),
    ("gov,doi", None),
    ("gov)/", None),
    ("com,doi)/", None),
    ("", None),
    (None, None),
]


def test_three_key_shapes(rows):
    df = rows("k string, want string", *KEYS)
    got = df.select(dom.surt_domain("k", ("ed.gov", "doi.gov")), "want").collect()
    assert all(a == b for a, b in got)


def test_first_listed_domain_wins(rows):
    df = rows("k string", ("gov,b,a)/",), ("gov,b,c)/",), ("gov,x)/",))
    def labels(order):
        return [r[0] for r in df.select(dom.surt_domain("k", order)).collect()]

    assert labels(("b.gov", "a.b.gov")) == ["b.gov", "b.gov", None]
    assert labels(("a.b.gov", "b.gov")) == ["a.b.gov", "b.gov", None]


def test_host_labels(rows):
    df = rows("h string", ("doi.gov",), ("x.doi.gov",), ("notdoi.gov",), ("doi.gov:8080",), ("",), (None,))
    got = [r[0] for r in df.select(dom.host_domain("h", ("doi.gov",))).collect()]
    assert got == ["doi.gov", "doi.gov", None, None, None, None]
    one = [r[0] for r in df.where(dom.is_host_in("h", "doi.gov")).collect()]
    assert one == ["doi.gov", "x.doi.gov"]


def test_targets_and_rest_leave_out_null_keys(rows):
    df = rows("surtkey string", *[(k,) for k, _ in KEYS])
    inside = dom.only_targets(df, ("doi.gov",)).count()
    outside = dom.outside_targets(df, ("doi.gov",)).count()
    assert (inside, outside) == (4, 5)


def test_port_makes_registered_domain_other(rows):
    df = rows("surtkey string", ("gov,doi:8080)/",), ("gov,doi)/",))
    got = [r[0] for r in df.select(dom.registered_or_other(df, ("doi.gov",))).collect()]
    assert got == ["other", "doi.gov"]


def test_folders_are_numbered_alphabetically():
    names = dom.folder_names()
    assert names["commerce.gov"] == "01_commerce"
    assert names["va.gov"] == "15_va"
    assert len(names) == 15


def test_single_domain_filter_reaches_the_scan(spark, rows, tmp_path):
    rows("surtkey string", *[(k,) for k, _ in KEYS]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(dom.is_one_domain("surtkey", "doi.gov"))
    assert df.count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(surtkey,gov,doi))" in plan


def test_dimension_join_matches_the_expression(spark, rows, collect):
    df = rows("surtkey string", *[(k,) for k, _ in KEYS])
    dim = dom.domain_dimension(spark, ("doi.gov", "ed.gov"))
    joined = collect(dom.label_from_dimension(df, dim), "surtkey", "domain")
    plain = collect(
        df.withColumn("domain", dom.surt_domain("surtkey", ("doi.gov", "ed.gov"))).where(
            F.col("domain").isNotNull()
        ),
        "surtkey",
        "domain",
    )
    assert joined == plain


NESTED = ("gov", "doi.gov", "data.doi.gov", "ed.gov", "a.b.ed.gov")


def longest(key, domains):
    """The deepest domain whose SURT prefix ends at a label of the key."""
    hits = [d for d in domains if key and any(key.startswith(",".join(reversed(d.split("."))) + end) for end in ",):")]
    return max(hits, key=lambda d: d.count("."), default=None)


def test_labels_of_any_depth(spark, rows, collect):
    keys = [k for k, _ in KEYS] + ["gov,doi,data)/x", "gov,doi,data,deep)/", "gov,doi,database)/", "gov)/", "gov,ed,b,a:81)/", "com,x)/", "", None, "gov,doi,data"]
    df = rows("surtkey string, `_hit` int, folder int", *[(k, 1, 2) for k in keys]).drop("folder")
    for domains in (NESTED, NESTED[:1], NESTED[2:], NESTED[1:2], ()):
        dim = dom.domain_dimension(spark, domains) if domains else dom.domain_dimension(spark, ("x.gov",)).limit(0)
        want = [(k, longest(k, domains)) for k in keys]
        left = dom.label_from_dimension(df, dim, how="left")
        assert left.columns == ["surtkey", "_hit", "domain", "folder"]
        assert sorted(map(str, [(r.surtkey, r.domain) for r in left.collect()])) == sorted(map(str, want))
        inner = dom.label_from_dimension(df, dim)
        assert sorted(map(str, [(r.surtkey, r.domain) for r in inner.collect()])) == sorted(str(w) for w in want if w[1])


def test_dimension_must_list_a_domain_once(spark, rows):
    dim = dom.domain_dimension(spark, ("doi.gov", "ed.gov"))
    with pytest.raises(ValueError, match="twice"):
        dom.label_from_dimension(rows("surtkey string", ("gov,doi)/",)), dim.union(dim))


def test_stored_labels_are_partition_filters(spark, rows, tmp_path):
    data = rows("url_surtkey string, base_domain string", ("gov,doi)/", "doi.gov"), ("gov,x)/", "other"), (None, None))
    data.write.partitionBy("base_domain").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for kept, n in ((dom.only_targets(df, ("doi.gov",), "url_surtkey"), 1), (dom.outside_targets(df, ("doi.gov",), "url_surtkey"), 1)):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "base_domain" in plan.split("PartitionFilters: [")[1].split("]")[0] and kept.count() == n

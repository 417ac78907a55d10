"""SQL functions against the column functions, and reports written in SQL text."""

import pytest
from pyspark.sql import functions as F

from surtscope import catalog
from surtscope.functions import sql, urls
from surtscope.operators import domains as dom
from surtscope.plans import overview

FOLDER = "/root/testdata/sf0.001"
TARGETS = ("doi.gov", "a.ed.gov", "ed.gov", "example.com")
URLS = ["HTTP://X.gov/", "http://Doi.gov:80/a/b?q=1?r#f", "dns:ed.gov", "http://h", "ftp://u@h.gov/x.PDF", "", "x?y\n", "http://doi.gov/a/'q'", None]
KEYS = ["gov,doi)/", "gov,doi:81)/A/b.PDF?x", "gov,ed,a,b)/node/1", "gov,ed)/x/y/z.tar.gz", "gov)/", ")/", "", "gov,doi", "com,example,www)//a//", None]
BY_URL = {
    "url_host": urls.host, "url_authority_host": urls.authority_host, "url_host_and_port": urls.host_and_port,
    "url_path": urls.url_path, "url_query": urls.url_query,
}
BY_KEY = {
    "surt_host": urls.surt_host, "surt_path": urls.surt_path, "surt_parts": urls.surt_host_parts, "surt_tld": urls.tld,
    "surt_base_domain": urls.registered_domain, "surt_subdomain": urls.full_subdomain, "surt_extension": urls.extension,
    "surt_filename": urls.filename, "surt_pdf_name": urls.pdf_name, "surt_path_depth": urls.path_depth,
    "surt_target_domain": lambda c: dom.surt_domain(c, TARGETS),
}


@pytest.fixture(scope="module")
def names(spark):
    return sql.register(spark, TARGETS)


def test_every_function_equals_its_column(rows, names):
    tested = set()
    for values, functions in ((URLS, BY_URL), (KEYS, BY_KEY)):
        df = rows("v string", *[(v,) for v in values])
        for name, column in functions.items():
            got = df.select("v", F.expr(f"{name}(v)").alias("a"), column("v").alias("b")).collect()
            assert [r.a for r in got] == [r.b for r in got], name
            tested.add(name)
    df = rows("v string", *[(v,) for v in KEYS])
    got = df.select(F.expr("path_segment(surt_path(v), 2)").alias("a"), urls.surt_path_segment("v", 2).alias("b"))
    got = got.union(df.select(F.expr("label_if_empty(surt_tld(v), '(none)')"), urls.label_if_empty(urls.tld("v"), "(none)")))
    got = got.union(df.select(F.expr("string(surt_in_domain(v, 'ed.gov'))"), dom.is_one_domain("v", "ed.gov").cast("string")))
    got = got.union(rows("v string", ("doi.gov",), ("a.b.c",)).select(F.expr("surt_prefix(v)"), urls.surt_prefix("v")))
    assert all(r.a == r.b for r in got.collect())
    assert tested | {"path_segment", "label_if_empty", "surt_in_domain", "surt_prefix"} == set(names)


def test_a_report_in_sql_text_equals_its_function(spark, names, collect):
    captures = catalog.Archive(spark, FOLDER).captures()
    captures.createOrReplaceTempView("sql_captures")
    text = spark.sql("""
        SELECT base_domain, subdomain, count(*) AS n FROM (
            SELECT surt_base_domain(surtkey) AS base_domain, surt_subdomain(surtkey) AS subdomain FROM sql_captures)
        WHERE base_domain = 'example.com' AND subdomain <> '' GROUP BY ALL""")
    plain = captures.select(urls.registered_domain().alias("base_domain"), urls.full_subdomain().alias("subdomain"))
    plain = plain.where("base_domain = 'example.com' AND subdomain <> ''").groupBy("base_domain", "subdomain").agg(F.count(F.lit(1)).alias("n"))
    assert collect(text) == collect(plain)
    summary = spark.sql("""
        SELECT surt_base_domain(surtkey) AS base_domain, count(*) AS total_captures,
               count(DISTINCT surt_subdomain(surtkey)) AS unique_subdomains FROM sql_captures
        WHERE surt_base_domain(surtkey) IS NOT NULL GROUP BY 1""")
    assert collect(summary) == collect(overview.domain_summary(captures, "full"), *summary.columns)


def test_a_prefix_written_in_sql_reaches_the_scan(spark, names):
    catalog.Archive(spark, FOLDER).captures().createOrReplaceTempView("sql_captures")
    df = spark.sql("SELECT count(*) FROM sql_captures WHERE surt_in_domain(surtkey, 'example.com')")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(surtkey,com,example))" in plan

"""Hand-made URL and SURT cases with their expected columns."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surtscope.functions import urls
from surtscope.operators import domains as dom

TARGETS = ("doi.gov", "ed.gov", "va.gov")

# id, url, surtkey
CASES = [
    ("A1", "http://www.doi.gov/", "gov,doi)/"),
    ("A2", "https://data.doi.gov/api/Views/Foo.PDF?fmt=json#x", "gov,doi,data)/api/views/foo.pdf?fmt=json"),
    ("A3", "http://iosst1.ios.doi.gov/a/b/c/d/e/f.html", "gov,doi,ios,iosst1)/a/b/c/d/e/f.html"),
    ("A4", "http://doi.gov:8080/x/", "gov,doi:8080)/x"),
    ("A5", "dns:www.Ed.gov", "gov,ed)/"),
    ("A6", "ftp://ftp.va.gov/pub//file.tar.gz", "gov,va,ftp)/pub//file.tar.gz"),
    ("A7", "HTTP://ED.GOV/UP", "gov,ed)/up"),
    ("A8", "http://user:pw@ed.gov/x", "gov,ed)/x"),
    ("A9", "http://ed.gov/a)b?c=d", "gov,ed)/a)b?c=d"),
    ("A10", "http://ed.gov", "gov,ed)/"),
    ("A11", "http://notdoi.gov/", "gov,notdoi)/"),
    ("A12", "http://ed.gov/q", "malformed"),
    ("A13", "http://ed.gov/node/0012", "gov,ed)/node/0012"),
    ("A14", "http://ed.gov/node/1.5", "gov,ed)/node/1.5"),
    ("A15", None, None),
]
COLUMNS = (
    "host url_path url_query path_seg_1 path_seg_2 surthost surthost_seg_0 surthost_seg_1 "
    "surthost_seg_2 surthost_seg_3 surtpath_1 surtpath_2 surtpath_5 reg_domain sub_full ext "
    "filename depth target number"
).split()
N = None
EXPECTED = {
    "A1": ("www.doi.gov", "/", "", "", N, "gov,doi", "gov", "doi", N, N, "", N, N, "doi.gov", "", "", "", 1, "doi.gov", N),
    "A2": ("data.doi.gov", "/api/Views/Foo.PDF", "fmt=json#x", "api", "Views", "gov,doi,data", "gov", "doi", "data", N, "api", "views", N, "doi.gov", "data", "pdf", "foo.pdf", 3, "doi.gov", N),
    "A3": ("iosst1.ios.doi.gov", "/a/b/c/d/e/f.html", "", "a", "b", "gov,doi,ios,iosst1", "gov", "doi", "ios", "iosst1", "a", "b", "e", "doi.gov", "iosst1.ios", "html", "f.html", 6, "doi.gov", N),
    "A4": ("doi.gov", "/x/", "", "x", N, "gov,doi:8080", "gov", "doi:8080", N, N, "x", N, N, "doi:8080.gov", "", "", "x", 1, "doi.gov", N),
    "A5": ("www.ed.gov", "", "", "", N, "gov,ed", "gov", "ed", N, N, "", N, N, "ed.gov", "", "", "", 1, "ed.gov", N),
    "A6": ("ftp.va.gov", "/pub//file.tar.gz", "", "pub", "", "gov,va,ftp", "gov", "va", "ftp", N, "pub", "", N, "va.gov", "ftp", "gz", "file.tar.gz", 3, "va.gov", N),
    "A7": ("", "", "", "", N, "gov,ed", "gov", "ed", N, N, "up", N, N, "ed.gov", "", "", "up", 1, "ed.gov", N),
    "A8": ("user", "/x", "", "x", N, "gov,ed", "gov", "ed", N, N, "x", N, N, "ed.gov", "", "", "x", 1, "ed.gov", N),
    "A9": ("ed.gov", "/a)b", "c=d", "a)b", N, "gov,ed", "gov", "ed", N, N, "a)b", N, N, "ed.gov", "", "", "a)b", 1, "ed.gov", N),
    "A10": ("ed.gov", "", "", "", N, "gov,ed", "gov", "ed", N, N, "", N, N, "ed.gov", "", "", "", 1, "ed.gov", N),
    "A11": ("notdoi.gov", "/", "", "", N, "gov,notdoi", "gov", "notdoi", N, N, "", N, N, "notdoi.gov", "", "", "", 1, N, N),
    "A12": ("ed.gov", "/q", "", "q", N, "", "", N, N, N, "", N, N, N, "", "", "", 1, N, N),
    "A13": ("ed.gov", "/node/0012", "", "node", "0012", "gov,ed", "gov", "ed", N, N, "node", "0012", N, "ed.gov", "", "", "0012", 2, "ed.gov", 12),
    "A14": ("ed.gov", "/node/1.5", "", "node", "1.5", "gov,ed", "gov", "ed", N, N, "node", "1.5", N, "ed.gov", "", "5", "1.5", 2, "ed.gov", N),
    "A15": (N, N, N, N, N, N, N, N, N, N, N, N, N, N, "", N, N, N, N, N),
}


@pytest.fixture(scope="module")
def derived(spark):
    df = spark.createDataFrame(CASES, "id string, url string, surtkey string")
    full = urls.with_derived_columns(urls.with_surt_columns(urls.with_url_columns(df)))
    full = full.withColumns(
        {"target": dom.surt_domain("surtkey", TARGETS), "number": F.col("surtpath_2").try_cast("int")}
    )
    return {r["id"]: tuple(r)[1:] for r in full.select("id", *COLUMNS).collect()}


@pytest.mark.parametrize("case", [c[0] for c in CASES])
def test_hand_made_cases(derived, case):
    assert dict(zip(COLUMNS, derived[case])) == dict(zip(COLUMNS, EXPECTED[case]))


def test_early_host_forms(rows, collect):
    df = rows("url string", ("http://A.gov:80/x",), ("https://a.gov/",), ("dns:a.gov",))
    df = rows("url string", ("http://A.gov:80/x?y",), ("dns:a.gov",))
    got = collect(df, urls.authority_host("url"), urls.host_and_port("url"))
    assert got == [("", ""), ("a.gov", "a.gov:80")]


def test_path_labels(rows, collect):
    df = rows("p string", ("",), ("/",), ("/a/",), ("/a/b/c",), ("//",), (None,))
    got = dict(
        (r[0], r[1:]) for r in collect(df, "p", urls.first_segment("p"), urls.first_two_segments("p"))
    )
    assert got[""] == ("(root)", "(root)")
    assert got["/"] == ("(root)", "(root)")
    assert got["/a/"] == ("a", "a")
    assert got["/a/b/c"] == ("a", "a/b")
    assert got["//"] == ("(root)", "")
    assert got[None] == ("(root)", "(root)")


def test_final_newline_is_not_the_end(rows, collect):
    df = rows("k string", ("gov,ed)/a.pdf\n",))
    assert collect(df, urls.extension("k"), urls.pdf_name("k")) == [("", "")]


def test_stored_columns_win_over_patterns(rows):
    df = rows("surtkey string, ext string", ("gov,ed)/a.pdf", "stored"))
    assert df.select(urls.stored_or(df, "ext", urls.extension())).first()[0] == "stored"
    bare = df.drop("ext")
    assert bare.select(urls.stored_or(bare, "ext", urls.extension())).first()[0] == "pdf"


def test_prefix_of_a_domain(rows):
    df = rows("d string", ("doi.gov",), ("a.b.gov",))
    assert [r[0] for r in df.select(urls.surt_prefix("d")).collect()] == ["gov,doi", "gov,b,a"]
    assert urls.surt_prefix_of("a.b.gov") == "gov,b,a"


_label = st.text("abcdefgh0123456789-", min_size=1, max_size=6)


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.lists(_label, min_size=1, max_size=6),
            st.lists(st.text("abc.-)", max_size=4), max_size=5),
        ),
        min_size=1,
        max_size=20,
    )
)
def test_segments_rebuild_the_host(spark, cases):
    keys = [(",".join(h) + ")/" + "/".join(p),) for h, p in cases]
    df = urls.with_surt_columns(spark.createDataFrame(keys, "surtkey string"))
    segments = F.array_join(F.array(*[f"surthost_seg_{i}" for i in range(6)]), ",")
    for joined, host, key in df.select(segments, "surthost", "surtkey").collect():
        assert joined == host == key.split(")")[0]

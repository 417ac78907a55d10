"""Capture lines: good ones, every kind of broken one, and line numbers."""

import gzip
import json

import pytest

from surtscope.config import resolve_years
from surtscope.sources import cdxj, derived

GOOD = 'gov,doi,data)/api/x?f=json 20240105120000 ' + json.dumps(
    {
        "url": "https://data.doi.gov/api/x?f=json",
        "mime": "text/html",
        "status": "200",
        "digest": "AAAA",
        "length": "1234",
        "offset": "0",
        "filename": "a.warc.gz",
        "mime-detected": "text/html",
        "languages": "eng",
    }
)
DNS_LINE = (
    'gov,ed)/ 20240105120001 {"url":"dns:www.ed.gov","mime":"text/dns","digest":"BBBB",'
    '"length":"60","offset":"9","filename":"a.warc.gz"}'
)
BROKEN = [
    ("bad line", "ValueError"),
    ("", "ValueError"),
    ('k ts {"url":', "JSONDecodeError"),
    ('k ts {"a":"1","b":2', "JSONDecodeError"),
    ("k ts [1]", "TypeError"),
    ("k ts 5", "TypeError"),
    ("k ts null", "TypeError"),
    ('k ts {"a":"1"} xyz', "JSONDecodeError"),
    ('k ts {"a":"1"} {"a":"2"}', "JSONDecodeError"),
    ('k ts {"a":"1"},{"a":"2"}', "JSONDecodeError"),
    ('k ts {"a":"1"}]', "JSONDecodeError"),
    ('k ts {"a":"1"}] , [{"a":"2"}', "JSONDecodeError"),
    ("k ts {'a':'1'}", "JSONDecodeError"),
    ('k  ts {"url":"u"}', "JSONDecodeError"),
    ('k ts {"status":"-"}', "ConversionError"),
    ('k ts {"length":"many"}', "ConversionError"),
]
FINE = [
    GOOD,
    DNS_LINE,
    'k ts {"url":"u","url":"v"}',
    '\tk ts {"url":"tabs"} \t',
    'k ts {}',
    'k ts \t{"url":"tab before the object"}',
    'k ts {"url":"has ] and } inside","x":[{"y":1}]}',
    'k ts {"status":200,"length":12}',
]


def write(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / name, "wt", encoding="utf-8") as f:
        f.write("".join(line + "\n" for line in lines))


@pytest.fixture
def lines(spark, tmp_path):
    def read(*files):
        for i, content in enumerate(files):
            write(tmp_path / "CRAWL-2024", f"f{i}.cdxj.gz", content)
        return cdxj.read_lines(spark, str(tmp_path / "CRAWL-2024"))

    return read


def test_good_lines(lines, collect):
    got = collect(cdxj.records(lines(FINE)), "surtkey", "timestamp", "url", "status")
    assert ("gov,ed)/", "20240105120001", "dns:www.ed.gov", None) in got
    assert ("k", "ts", "v", None) in got, "the last of two equal keys wins"
    assert ("k", "ts", "tabs", None) in got
    assert ("k", "ts", "has ] and } inside", None) in got
    assert ("k", "ts", None, "200") in got
    assert len(got) == len(FINE)


@pytest.mark.parametrize("line,kind", BROKEN)
def test_each_broken_line_is_quarantined(lines, line, kind):
    df = lines([GOOD, line, GOOD])
    got = cdxj.errors(df).collect()
    assert [(r.line, r.error_type, r.raw_line_preview) for r in got] == [(2, kind, line.strip())]
    assert cdxj.records(df).count() == 2


def test_line_numbers_over_many_files(lines):
    files, want = [], set()
    for i in range(5):
        content = []
        for n in range(1, 400):
            broken = (n * 7 + i) % 97 == 0
            content.append("bad line" if broken else GOOD)
            if broken:
                want.add((f"f{i}.cdxj.gz", n))
        files.append(content)
    got = {(r.file.rsplit("/", 1)[1], r.line) for r in cdxj.errors(lines(*files)).collect()}
    assert got == want


def test_file_of_broken_lines_only(lines):
    got = sorted(r.line for r in cdxj.errors(lines(["x"] * 5)).collect())
    assert got == [1, 2, 3, 4, 5]


def test_preview_is_cut_and_types_are_counted(lines):
    df = lines(["y" * 500, "", "k ts [1]"])
    bad = cdxj.errors(df)
    assert max(len(r.raw_line_preview) for r in bad.collect()) == 200
    assert [tuple(r) for r in cdxj.error_type_counts(bad).collect()] == [("ValueError", 2), ("TypeError", 1)]


def test_untyped_reading_keeps_unconvertible_fields(lines):
    df = lines(['k ts {"status":"-"}'])
    assert cdxj.records(df, typed=False).first().status == "-"
    assert cdxj.errors(df, typed=False).count() == 0


def test_capture_columns_and_types(lines):
    df = cdxj.captures(cdxj.records(lines(FINE)), "2024", ("doi.gov", "ed.gov"))
    assert len(df.columns) == 34
    assert df.schema == cdxj.capture_schema() or [f.dataType for f in df.schema] == [
        f.dataType for f in cdxj.capture_schema()
    ]
    row = df.where("surthost = 'gov,doi,data'").first()
    assert (row.status, row.length, row.warc_filename, row.crawl_year) == (200, 1234, "a.warc.gz", "2024")
    assert (row.surthost_seg_2, row.surtpath_2, row.path_seg_2) == ("data", "x", "x")
    assert df.count() == 2


def test_dns_scan(lines):
    near_miss = 'gov,ed)/ 20240105120002 {"url":"dns:x.ed.gov","mime":"text/html"}'
    got = cdxj.dns_records(lines([*FINE, near_miss, "broken \"url\":\"dns:"])).collect()
    assert [r.url for r in got] == ["dns:www.ed.gov"]


def test_year_argument():
    assert resolve_years("all") == ["2004", "2008", "2012", "2016", "2020", "2024"]
    assert resolve_years([2012, "2016"]) == ["2012", "2016"]
    with pytest.raises(ValueError):
        resolve_years([2013])


def test_year_from_path(lines):
    df = lines([GOOD])
    assert df.select(cdxj.year_from_path()).first()[0] == "2024"


def test_archive_lines_break_one_line_after_each_redirect(rows, collect):
    schema = "event_id long, crawl_year string, shard long, timestamp string, " + ", ".join(
        f"`{c}` string" for c in [*cdxj.JSON_KEYS, "surtkey"]
    )
    nulls = dict.fromkeys(cdxj.JSON_KEYS)
    made = [
        (e, "2020", 0, "20200101000000", *{**nulls, "url": "u", "status": s}.values(), "k")
        for e, s in ((0, "301"), (1, "200"), (2, None), (5, "301"))
    ]
    head = 'k 20200101000000 {"url":"u"'
    found = collect(derived.archive_lines(rows(schema, *made)), "event_id", "part", "value")
    assert found == [
        (0, 0, head + ',"status":"301"}'), (0, 1, "k"), (1, 0, head + ',"status":"200"}'),
        (2, 0, head + "}"), (5, 0, head + ',"status":"301"}'), (5, 1, ""),
    ]

"""Archives: every record comes back, copies revisit the smallest page."""

import base64
import hashlib
from collections import Counter, defaultdict

from surtscope.llm import warc
from surtscope.session import run_folder

PAGES = [
    (3, "http://a/", "same"), (1, "http://b/ü\r\nX: y", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""),
    (6, "u", "line\r\n\r\nWARC/1.1\r\n\r\n"), (None, "n", "only"), (None, "m", "same"), (7, "u", "é" * 40000), (7, "u", "é" * 40000),
]


def brute(rows):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        first = min((x for x in groups[h or ""] if x is not None), default=None)
        revisit = i != first
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out[i, len(body), sha, "revisit" if revisit else "response", first if revisit else None] += 1
    return out


def found(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_odd_pages(rows):
    df = rows("page_id long, url string, html string, file string, offset long", *((*p, "f", 1) for p in PAGES))
    assert found(warc.round_trip(df)) == brute(PAGES)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in df.collect()]
    assert found(warc.round_trip(df)) == brute(rows)


def test_selected_records_and_payloads(spark, rows):
    df = rows("page_id long, url string, html string", *PAGES)
    folder = run_folder(spark, "warc-test")
    index = warc.write_archives(df, folder, min_revisit_bytes=5)
    picked = warc.read_records(index.where("page_id in (1, 6, 7)"), folder).collect()
    assert Counter((r.page_id, r.record_type) for r in picked) == {(1, "response"): 1, (6, "response"): 1, (7, "response"): 2}
    assert {bytes(r.payload).decode() for r in picked if r.page_id == 6} == {PAGES[5][2]}


def test_ranges():
    assert warc.coalesce_ranges([(0, 10), (12, 5), (100, 1)], gap=4) == [(0, 17, [0, 1]), (100, 101, [2])]

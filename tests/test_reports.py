"""Reports on hand-made captures, against brute force in plain Python."""

import random
from collections import Counter, defaultdict

import pytest

from surtscope import session
from surtscope.config import CRAWL_YEARS, TARGET_DOMAINS
from surtscope.functions import urls
from surtscope.plans import content, dedup, dns, hosts, overview, reconcile, structure

SCHEMA = (
    "surtkey string, fetch_timestamp string, crawl_year string, url string, digest string, "
    "mime string, status int, length bigint"
)
TARGETS = ("doi.gov", "ed.gov")


@pytest.fixture(scope="module")
def data():
    """A third of all rows share one key; some keys, times and digests are NULL."""
    rng = random.Random(3)
    out = []
    for i in range(1500):
        key = "gov,doi)/hot" if i % 3 == 0 else f"gov,{rng.choice(['doi', 'ed', 'other'])},s{i % 4})/p{i % 90}"
        key = None if i % 101 == 0 else key
        stamp = None if i % 37 == 0 else f"2024010{i % 7}00000{i % 3}"
        url = None if key is None else "http://x.gov/" + key.split(")")[1]
        out.append(
            (key, stamp, rng.choice(CRAWL_YEARS[3:]), url, rng.choice([None, "a", "b"]), rng.choice(["text/html", "text/dns", None]), rng.choice([200, 302, 404, None]), i % 50)
        )
    return out


@pytest.fixture(scope="module")
def captures(spark, data):
    return urls.with_surt_columns(spark.createDataFrame(data, SCHEMA))


def label(key):
    for d in TARGETS:
        p = urls.surt_prefix_of(d)
        if key and key.startswith((p + ")", p + ":", p + ",")):
            return d
    return None


def test_duplication_counts(captures, data):
    want = defaultdict(lambda: [0, set(), set()])
    for key, stamp, year, *_ in data:
        if label(key):
            cell = want[(label(key), year)]
            cell[0] += 1
            cell[2].add(key)
            if stamp is not None:
                cell[1].add((key, stamp))
    got = {(r.domain, r.crawl_year): r for r in dedup.duplication(captures, TARGETS).collect()}
    assert set(got) == set(want)
    for k, (rows, pairs, keys) in want.items():
        r = got[k]
        assert (r.total_rows, r.unique_surt_ts, r.unique_surturls) == (rows, len(pairs), len(keys))
        assert (r.true_duplicates, r.multi_capture) == (rows - len(pairs), rows - len(keys))
        assert r.redundancy_pct == pytest.approx(100 * (1 - len(keys) / rows), abs=0.006)


def test_overlap_and_most_captured(captures, data):
    years = defaultdict(set)
    counts = Counter()
    for key, _, year, *_ in data:
        if label(key):
            years[(label(key), key)].add(year)
            counts[(label(key), key, year)] += 1
    for r in dedup.year_overlap(captures, TARGETS).collect():
        sizes = Counter(len(v) for (d, _), v in years.items() if d == r.domain)
        assert [r[f"{i} year(s)"] for i in range(1, 7)] == [sizes[i] for i in range(1, 7)]
    top = dedup.most_captured(captures, TARGETS, 3).collect()
    for d in TARGETS:
        best = sorted(((-n, k, y) for (dd, k, y), n in counts.items() if dd == d))[:3]
        assert [(-r.captures, r.surtkey, r.crawl_year) for r in top if r.domain == d] == best


def test_domain_summary(captures, data):
    groups = defaultdict(list)
    for key, _, year, *_ in data:
        if key:
            labels = key.split(")")[0].split(",")
            groups[f"{labels[1]}.{labels[0]}"].append((labels[2] if len(labels) > 2 else "", year))
    got = {r.base_domain: r for r in overview.domain_summary(captures).collect()}
    assert set(got) == set(groups)
    for d, rows in groups.items():
        subs = Counter(s for s, _ in rows)
        name, n = sorted(subs.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        r = got[d]
        assert (r.total_captures, r.unique_subdomains, r.years_covered) == (len(rows), len(subs), len({y for _, y in rows}))
        assert (r.top_subdomain, r.top_subdomain_count, r.bare_captures) == (name, n, subs[""])


def test_subdomain_level(rows):
    df = urls.with_surt_columns(rows("surtkey string, crawl_year string", ("gov,doi,ios,x)/", "2024"), ("gov,doi)/", "2024")))
    def subs(level):
        return sorted(r.subdomain for r in overview.subdomain_breakdown(df, level=level).collect())

    assert subs("top") == ["(bare/www)", "ios"]
    assert subs("full") == ["(bare/www)", "x.ios"]
    assert overview.unique_subdomains(df).first().n == 2
    with pytest.raises(ValueError):
        overview.domain_summary(df, "other")


def test_size_statistics(captures, data):
    sizes = defaultdict(list)
    for key, *_, length in data:
        if length > 0:
            labels = key.split(")")[0].split(",") if key else None
            d = f"{labels[1]}.{labels[0]}" if labels else None
            sizes[d if d in TARGETS else "other"].append(length)
    for r in content.size_statistics(captures, TARGETS).collect():
        v = sorted(sizes[r.base_domain])
        assert (r.n, r.min_bytes, r.max_bytes, r.total_bytes) == (len(v), v[0], v[-1], sum(v))
        mid = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
        assert r.median_bytes == round(mid)
        assert r.avg_bytes == round(sum(v) / len(v))


def test_shares_add_up(captures, data):
    status = content.status_distribution(captures).collect()
    assert sum(r.captures for r in status) == len(data)
    assert sum(r.pct for r in status) == pytest.approx(100, abs=0.05)
    for r in content.status_classes_by_domain(captures, TARGETS).collect():
        assert sum(r[c] for c in ("2xx", "3xx", "4xx", "5xx", "other")) == pytest.approx(100, abs=0.25)


def test_dns_reports(captures, data):
    want = Counter(label(k) for k, *_, mime, _, _ in data if mime == "text/dns")
    for r in dns.dns_share(captures, TARGETS).collect():
        assert r.dns_records == want[r.domain]
    with_host = captures.withColumn("host", urls.surt_host())
    assert dns.dns_totals(with_host, "ed.gov").first().total_dns_records == want["ed.gov"]
    buckets = dns.dns_repeats(with_host, "ed.gov").collect()
    assert sum(r.total_dns_records for r in buckets) == want["ed.gov"]


def test_matrix_of_the_default_domains(spark, rows):
    """15 folders, two sources, six years and their totals, zeros included."""
    c = rows("surtkey string, crawl_year string", ("gov,doi)/", "2004"), ("gov,doi:81)/", "2004"), ("gov,va,x)/", "2024"), ("gov,no)/", "2024"), (None, "2024"))
    p = rows("url_surtkey string, crawl_year string", ("gov,doi)/", "2004"), ("gov,no)/", "2008"))
    m = reconcile.domain_year_matrix(spark, c, p)
    assert m.columns[0] == "folder" and len(m.columns) == 15
    table = {r.folder: r for r in m.collect()}
    assert list(table) == sorted(table) and len(table) == len(TARGET_DOMAINS)
    doi, va = table["04_doi"], table["15_va"]
    assert (doi["2004 CDXJ"], doi["ALL CDXJ"], doi["2004 parquet"], doi["ALL parquet"]) == (2, 2, 1, 1)
    assert (va["2024 CDXJ"], va["ALL CDXJ"], va["ALL parquet"]) == (1, 1, 0)
    assert sum(r["ALL CDXJ"] for r in table.values()) == 3


def test_reconciliation_edges(rows, collect):
    c = rows("surtkey string, crawl_year string, url string, digest string", ("gov,doi)/", "2004", "u", None), ("gov,doi)/", "2004", "u", None), ("gov,x)/", "2008", None, "d"))
    p = rows("url_surtkey string, crawl_year string, url string, content_digest string, subset string", ("gov,ed)/", "2012", "u", "d", "warc"), (None, "2012", "v", "d", "cdx"))
    assert collect(reconcile.year_diff(c, p)) == [("2004", None, 2, None), ("2008", None, 1, None), ("2012", 2, None, None)]
    assert collect(reconcile.domain_diff(c, p, TARGETS)) == [("doi.gov", 2, 0, -2), ("ed.gov", 0, 1, 1), ("other", 1, 0, -1)]
    # a NULL url is in no pair, so its row counts as a repeat
    assert collect(reconcile.duplicate_rows(c, p, TARGETS)) == [("CDXJ", 3, 2), ("parquet", 1, 0)]
    assert collect(reconcile.subset_breakdown(p, TARGETS)) == [("warc", 1)]


def test_paths_and_nodes(rows, collect):
    keys = ["gov,ed)/node/0012", "gov,ed)/node/1.5", "gov,ed)/node/x", "gov,ed)/node", "gov,ed)/", "gov,ed)/a/b.PDF?q"]
    df = urls.with_surt_columns(rows("surtkey string, crawl_year string", *[(k, "2024") for k in keys]))
    assert collect(structure.node_ids(df)) == [("2024", 4, 12, 12, 3)]
    depth = structure.path_depth(df).first()
    assert (depth.n, depth.avg_depth, depth.median_depth, depth.max_depth) == (5, 1.8, 2.0, 2)
    clean = structure.clean_urls(df).first()
    assert (clean.clean_urls, clean.static_files, clean.clean_pct) == (4, 2, 66.7)
    assert {r.seg1 for r in structure.path_prefixes(df, 1).collect()} == {"node", "(root)", "a"}
    assert "(none)" in {r.seg1 for r in structure.path_prefixes(df, 2).collect()}
    assert "(root)" in {r.seg1 for r in structure.path_prefixes(df, 2, root_label="(root)").collect()}


def test_host_reports(rows, collect):
    df = rows("url string", ("http://WWW.no.gov/x",), ("http://a.doi.gov:81/x/y/z",), ("http://doi.gov/",), ("dns:doi.gov",))
    assert collect(hosts.domain_hosts(df, TARGETS)) == [("doi.gov", "a.doi.gov", 1), ("doi.gov", "doi.gov", 1)]
    # with the port kept, the host no longer ends in the domain
    assert collect(hosts.domain_host_paths(df, TARGETS, 2)) == [("doi.gov", "doi.gov", "(root)", 1)]
    assert hosts.url_contains(df, "DOI.gov").first().n == 3


class _Session:
    """Just enough of a session to ask for its shared folder."""

    def __init__(self, master, settings):
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app"})()
        self.settings = settings
        self.conf = type("F", (), {"get": lambda _, k, d=None: settings.get(k, d), "set": lambda _, k, v: settings.update({k: v})})()


def test_shared_folder():
    named = _Session("spark://m", {"spark.checkpoint.dir": "/shared/x/"})
    assert session.shared_folder(named) == "/shared/x"
    with pytest.raises(RuntimeError):
        session.shared_folder(_Session("spark://m", {}))
    local = _Session("local[2]", {})
    assert session.shared_folder(local) == session.shared_folder(local) == local.settings["spark.checkpoint.dir"]

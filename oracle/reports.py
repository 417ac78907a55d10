"""SQL for every registered query, keyed like ``surtscope.catalog.queries()``."""

from __future__ import annotations

from oracle.base import DOMAINS, SP, YEARS, with_captures, with_errors, with_index

_LIST = ", ".join(f"'{d}'" for d in DOMAINS)
_OR_OTHER = f"CASE WHEN reg_domain IN ({_LIST}) THEN reg_domain ELSE 'other' END"
_EXT = rf"lower(regexp_extract({SP}, '\.([a-zA-Z0-9]+)$', 1))"
_EXT_LABEL = f"COALESCE(NULLIF({_EXT}, ''), '(none)')"
_NAME = f"regexp_extract({SP}, '/([^/]+)$', 1)"
_PDF = rf"regexp_extract({SP}, '/([^/]+\.pdf)$', 1)"
_DEPTH = "len(path_parts)"
#: A whole number once its digits are taken away is empty or a sign.
_NUMBER = """CASE WHEN translate(trim(surtpath_2), '0123456789', '') IN ('', '+', '-')
  THEN TRY_CAST(trim(surtpath_2) AS INTEGER) END"""
_SEG1 = "COALESCE(NULLIF(surtpath_1, ''), '(root)')"
_SUB = "COALESCE(surthost_seg_2, '(bare/www)')"


def _years(count: str = "count(*)", years=YEARS, total: bool = True) -> str:
    cols = [f"{count} FILTER (WHERE crawl_year = '{y}') AS \"{y}\"" for y in years]
    if total:
        cols.append(f"{count} FILTER (WHERE crawl_year IN ({_in(years)})) AS total")
    return ", ".join(cols)


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _pivot(select: str, where: str = "true", tail: str = "", keys: int = 1) -> str:
    group = ", ".join(str(i) for i in range(1, keys + 1))
    return with_captures(
        f"SELECT {select}, {_years()} FROM c WHERE {where} GROUP BY {group} {tail}"
    )


def _wide_total_order(label_col: str, k: int) -> str:
    return f"ORDER BY total DESC, {label_col} LIMIT {k}"


def _summary(domain: str, sub: str) -> str:
    return with_captures(f"""
, parsed AS (SELECT {domain} AS base_domain, {sub} AS subdomain, crawl_year FROM c
             WHERE surtkey IS NOT NULL AND {domain} IS NOT NULL),
ranked AS (SELECT base_domain, subdomain, count(*) AS n,
             row_number() OVER (PARTITION BY base_domain ORDER BY count(*) DESC, subdomain) AS r
           FROM parsed GROUP BY 1, 2)
SELECT s.*, t.subdomain AS top_subdomain, t.n AS top_subdomain_count,
       round(100.0 * bare_captures / total_captures, 1) AS pct_bare
FROM (SELECT base_domain, count(*) AS total_captures, count(DISTINCT subdomain) AS unique_subdomains,
             count(DISTINCT crawl_year) AS years_covered,
             count(*) FILTER (WHERE subdomain = '') AS bare_captures
      FROM parsed GROUP BY 1) s
LEFT JOIN (SELECT * FROM ranked WHERE r = 1) t USING (base_domain)""")


_DUP = """
by_moment AS (SELECT target AS domain, crawl_year, surtkey, fetch_timestamp, count(*) AS n
              FROM c WHERE target IS NOT NULL GROUP BY ALL),
by_url AS (SELECT domain, crawl_year, surtkey, sum(n) AS n, count(fetch_timestamp) AS moments
           FROM by_moment GROUP BY ALL),
by_key AS (SELECT domain, crawl_year, CAST(sum(n) AS BIGINT) AS total_rows,
                  CAST(sum(moments) AS BIGINT) AS unique_surt_ts, count(*) AS unique_surturls
           FROM by_url GROUP BY ALL),
dup AS (
  SELECT *, total_rows - unique_surturls AS multi_capture,
         round_even(100.0 * (1 - CAST(unique_surturls AS DOUBLE) / total_rows) * 100, 0) / 100 AS redundancy_pct
  FROM (SELECT domain, crawl_year, total_rows,
               unique_surt_ts, total_rows - unique_surt_ts AS true_duplicates, unique_surturls
        FROM by_key))"""

_OVERLAP = """
overlap AS (
  SELECT domain, {cols}, count(*) AS total_unique_surts
  FROM (SELECT target AS domain, surtkey, count(DISTINCT crawl_year) AS years_present
        FROM c WHERE target IS NOT NULL GROUP BY 1, 2)
  GROUP BY 1)""".format(
    cols=", ".join(
        f'count(*) FILTER (WHERE years_present = {i}) AS "{i} year(s)"' for i in range(1, 7)
    )
)

_NESTED = ", ".join(
    f"('{d}', '{','.join(reversed(d.split('.')))},')"
    for d in ("com", "example.com", "cheap-pills.example.com", "net", "example.org", "thther.example.org")
)
_P_TARGET = "target"
_DNS = "mime = 'text/dns' AND target = 'example.com'"
_MATRIX = f"""
counts AS (
  SELECT target AS domain, crawl_year AS year, 'CDXJ' AS source, count(*) AS n
  FROM c GROUP BY 1, 2
  UNION ALL
  SELECT {_P_TARGET}, crawl_year, 'parquet', count(*) FROM p GROUP BY 1, 2),
grid AS (
  SELECT d.domain, y.year, s.source, COALESCE(n, 0) AS n
  FROM (VALUES {', '.join(f"('{d}')" for d in DOMAINS)}) d(domain),
       (VALUES {', '.join(f"('{y}')" for y in YEARS)}) y(year),
       (VALUES ('parquet'), ('CDXJ')) s(source)
  LEFT JOIN counts k ON k.domain = d.domain AND k.year = y.year AND k.source = s.source),
long AS (
  SELECT domain, source, year, CAST(n AS BIGINT) AS n FROM grid
  UNION ALL
  SELECT domain, source, 'ALL', CAST(sum(n) AS BIGINT) FROM grid GROUP BY 1, 2)"""
_FOLDER = "CASE domain WHEN 'example.com' THEN '01_example' WHEN 'example.net' THEN '02_example.net' END"
_MATRIX_SQL = with_index(
    f", {_MATRIX} SELECT {_FOLDER} AS folder, "
    + ", ".join(
        f"CAST(sum(n) FILTER (WHERE year = '{y}' AND source = '{s}') AS BIGINT) AS \"{y} {s}\""
        for s in ("parquet", "CDXJ")
        for y in [*YEARS, "ALL"]
    )
    + " FROM long GROUP BY domain"
)


def _gap(keys: str, where: str = "true") -> str:
    cols = keys.split(", ")
    c_keys = ", ".join("COALESCE(target, 'other') AS base_domain" if k == "base_domain" else k for k in cols)
    p_keys = ", ".join(f"{_P_TARGET} AS base_domain" if k == "base_domain" else k for k in cols)
    group = ", ".join(str(i + 1) for i in range(len(cols)))
    return with_index(f"""
, l AS (SELECT {c_keys}, count(*) AS cdxj_rows FROM c GROUP BY {group}),
r AS (SELECT {p_keys}, count(*) AS parquet_rows FROM p WHERE {_P_TARGET} IS NOT NULL GROUP BY {group})
SELECT * FROM (
  SELECT {keys}, COALESCE(cdxj_rows, 0) AS cdxj_rows, COALESCE(parquet_rows, 0) AS parquet_rows,
         COALESCE(parquet_rows, 0) - COALESCE(cdxj_rows, 0) AS diff
  FROM l FULL OUTER JOIN r USING ({keys}))
WHERE {where}""")


_YEAR_DOMAIN = f"""
yd AS (
  SELECT crawl_year, domain, parquet_rows, cdxj_rows,
         COALESCE(parquet_rows, 0) - COALESCE(cdxj_rows, 0) AS diff
  FROM (SELECT crawl_year, {_OR_OTHER} AS domain, count(*) AS cdxj_rows FROM c GROUP BY 1, 2)
  FULL OUTER JOIN
       (SELECT crawl_year, url_host_registered_domain AS domain, count(*) AS parquet_rows
        FROM p WHERE url_host_registered_domain IN ({_LIST}) GROUP BY 1, 2)
  USING (crawl_year, domain))"""


def _year_diff(fill: bool) -> str:
    def f(c: str) -> str:
        return f"COALESCE({c}, 0)" if fill else c
    return with_index(f"""
SELECT crawl_year, {f('parquet_rows')} AS parquet_rows, {f('cdxj_rows')} AS cdxj_rows,
       {f('parquet_rows')} - {f('cdxj_rows')} AS diff
FROM (SELECT crawl_year, count(*) AS cdxj_rows FROM c GROUP BY 1)
FULL OUTER JOIN (SELECT crawl_year, count(*) AS parquet_rows FROM p GROUP BY 1) USING (crawl_year)""")


def _top_per(select: str, group: str, n_name: str, partition: str, order: str, k: int, where: str = "true") -> str:
    outer = ", ".join(x.split(" AS ")[-1] for x in select.split("; "))
    inner = select.replace("; ", ", ")
    return with_captures(f"""
SELECT {outer}, {n_name} FROM (
  SELECT *, row_number() OVER ({partition} ORDER BY {n_name} DESC, {order}) AS r
  FROM (SELECT {inner}, count(*) AS {n_name} FROM c WHERE {where} GROUP BY {group}))
WHERE r <= {k}""")


_CHURN_BASE = f"""
seen AS (SELECT {{keys}}{_SEG1} AS seg1, crawl_year FROM c GROUP BY ALL)"""


def _in_year(y: str) -> str:
    return f"(SELECT seg1 FROM seen WHERE crawl_year = '{y}')"


def _churn_counts(a: str, b: str) -> tuple[str, str, str]:
    A, B = _in_year(a), _in_year(b)
    return (
        f"(SELECT count(*) FROM ({A} EXCEPT {B}))",
        f"(SELECT count(*) FROM ({A} INTERSECT {B}))",
        f"(SELECT count(*) FROM ({B} EXCEPT {A}))",
    )


def _churn() -> str:
    gone, kept, fresh = _churn_counts("2020", "2024")
    return with_captures(f""", {_CHURN_BASE.format(keys='')}
SELECT 'Only in 2020' AS category, {gone} AS "count"
UNION ALL SELECT 'In both', {kept} UNION ALL SELECT 'Only in 2024', {fresh}""")


def _churn_all() -> str:
    rows = []
    for a, b in zip(YEARS, YEARS[1:]):
        gone, kept, fresh = _churn_counts(a, b)
        rows.append(f"SELECT '{a}→{b}' AS period, {gone} AS \"Disappeared\", {kept} AS \"Persisted\", {fresh} AS \"New\"")
    return with_captures(f", {_CHURN_BASE.format(keys='')} " + " UNION ALL ".join(rows))


def _rest(k: int, key: str = "") -> str:
    keys = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    group = f"GROUP BY {key}" if key else ""
    return with_captures(f"""
, t AS (SELECT {_BD_OF[key]}{_EXT_LABEL} AS ext, count(*) AS total FROM c GROUP BY ALL),
k AS (SELECT *, row_number() OVER ({part} ORDER BY total DESC, ext) AS r FROM t)
SELECT {keys}ext, total FROM k WHERE r <= {k}
UNION ALL
SELECT {keys}'(other)', COALESCE(CAST(sum(total) FILTER (WHERE r > {k}) AS BIGINT), 0) FROM k {group}""")


_BD = "COALESCE(target, 'other') AS base_domain"
_BD_OF = {"": "", "base_domain": f"{_BD}, "}


def _top_subs(key: str = "") -> str:
    keys = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    return with_captures(f"""
, t AS (SELECT {_BD_OF[key]}{_SUB} AS subdomain, crawl_year, count(*) AS n FROM c GROUP BY ALL),
tops AS (SELECT * FROM (SELECT *, row_number() OVER ({part} ORDER BY total DESC, subdomain) AS r
         FROM (SELECT {keys}subdomain, sum(n) AS total FROM t GROUP BY ALL)) WHERE r <= 8)
SELECT {keys}crawl_year, CASE WHEN r IS NULL THEN 'other' ELSE subdomain END AS subdomain,
       CAST(sum(n) AS BIGINT) AS n
FROM t LEFT JOIN tops USING ({keys}subdomain) GROUP BY ALL""")


def _depth(key: str = "") -> str:
    return with_captures(f"""
SELECT {_BD_OF[key]}crawl_year, count(*) AS n, CAST(sum({_DEPTH}) AS DOUBLE) / count(*) AS avg_depth,
       quantile_cont({_DEPTH}, 0.5) AS median_depth, CAST(max({_DEPTH}) AS INTEGER) AS max_depth
FROM c WHERE surtpath_1 > '' GROUP BY ALL""")


def _clean(key: str = "") -> str:
    return with_captures(f"""
SELECT *, round_even(CAST(clean_urls AS DOUBLE) / total * 100 * 10, 0) / 10 AS clean_pct
FROM (SELECT {_BD_OF[key]}crawl_year, count(*) FILTER (WHERE {_EXT} = '') AS clean_urls,
             count(*) FILTER (WHERE {_EXT} <> '') AS static_files, count(*) AS total
      FROM c GROUP BY ALL)""")


def _nodes(key: str = "") -> str:
    keys = "base_domain, crawl_year" if key else "crawl_year"
    return with_captures(f"""
, node AS (SELECT {_BD_OF[key]}crawl_year, surtpath_2 AS name, {_NUMBER} AS id, count(*) AS n
         FROM c WHERE surtpath_1 = 'node' GROUP BY ALL)
SELECT {keys}, CAST(sum(n) AS BIGINT) AS node_urls, min(id) AS min_node_id, max(id) AS max_node_id,
       count(name) AS unique_nodes
FROM node GROUP BY {keys}""")


def _per_domain(select: str, where: str = "true") -> str:
    return with_captures(f"SELECT {_BD}, {select} FROM c WHERE {where} GROUP BY ALL")


def _prefixes(depth: int, first: str | None = None, key: str = "") -> str:
    first = first or ("(root)" if depth == 1 else "(none)")
    segs = [f"COALESCE(NULLIF(surtpath_1, ''), '{first}') AS seg1"] + [
        f"COALESCE(NULLIF(surtpath_{i}, ''), '(none)') AS seg{i}" for i in range(2, depth + 1)
    ]
    return with_captures(f"SELECT {_BD_OF[key]}{', '.join(segs)}, {_years()} FROM c GROUP BY ALL")


def _limited_per_domain(sql: str, order: str, columns: str, k: int = 30) -> str:
    return f"""SELECT {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY base_domain ORDER BY total DESC, {order}) AS r
  FROM ({sql})) WHERE r <= {k}"""


def _ranked_paths(group: str, extra: str, where: str = "true") -> str:
    counted = _per_domain(f"{extra}{_SEG1} AS seg1, count(*) AS n", where)
    return f"""SELECT {group}, seg1, n FROM (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, seg1) AS r FROM ({counted}))
WHERE r <= 20"""


_YEAR_COLS = ", ".join(f'"{y}"' for y in YEARS)
_SIZE = f"""
SELECT *, round_even(total_bytes / 1e9 * 100, 0) / 100 AS total_gb FROM (
  SELECT {_OR_OTHER} AS base_domain, count(*) AS n, min("length") AS min_bytes,
    CAST(median("length") AS BIGINT) AS median_bytes,
    CAST(percentile_cont(0.95) WITHIN GROUP (ORDER BY "length") AS BIGINT) AS p95_bytes,
    max("length") AS max_bytes, CAST(avg("length") AS BIGINT) AS avg_bytes,
    CAST(sum("length") AS BIGINT) AS total_bytes
  FROM c WHERE "length" IS NOT NULL AND "length" > 0 GROUP BY 1)"""

_CLASSES = "CASE WHEN status // 100 IN (2, 3, 4, 5) THEN (status // 100) || 'xx' ELSE 'other' END"
_LAST_LABELS = "array_to_string(string_split(h, '.')[-2:], '.')"
_HOST_LABEL = f"CASE WHEN {_LAST_LABELS} IN ({_LIST}) THEN {_LAST_LABELS} END"
_PLAIN_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
_PORT_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1))"
_FIRST = "CASE WHEN path_seg_1 > '' THEN path_seg_1 ELSE '(root)' END"
_TWO = "CASE WHEN path_seg_1 > '' THEN concat_ws('/', path_seg_1, path_seg_2) ELSE '(root)' END"
_CAPTURE_COLUMNS = [
    "url", "host", "url_path", "url_query", *[f"path_seg_{i}" for i in range(1, 6)],
    "mime", "status", "digest", '"length"', '"offset"', "warc_filename", "mime_detected", "puid",
    "charset", "languages", "surtkey", "fetch_timestamp", "crawl_year", "surthost",
    *[f"surthost_seg_{i}" for i in range(6)], *[f"surtpath_{i}" for i in range(1, 6)],
]
_PENDING = """
want AS (SELECT 'crawl-data/' || md5(url) || '.cdxj.gz' AS key, md5(url) || '.cdxj.gz' AS name,
                CASE WHEN page_id % 2 = 0 THEN CAST(length(html) AS BIGINT) END AS size FROM pages),
have AS (SELECT md5(url) || '.cdxj.gz' AS name,
                CAST(length(html) - CASE WHEN contains(url, '?') THEN 1 ELSE 0 END AS BIGINT) AS size
         FROM pages WHERE contains(url, 'www.') OR contains(url, '?')),
todo AS (SELECT key, size FROM want w WHERE NOT EXISTS (
         SELECT 1 FROM have h WHERE h.name = w.name AND (w.size IS NULL OR w.size = h.size)))"""


def _reports() -> dict[str, str]:
    w, x = with_captures, with_index
    q = {
        "q01_overview": w("SELECT count(*) AS total_rows, count(DISTINCT host) AS distinct_hosts, count(DISTINCT crawl_year) AS crawl_years FROM c"),
        "q02_captures_per_host": w("SELECT host, count(*) AS captures FROM c GROUP BY 1"),
        "q03_captures_per_year": w("SELECT crawl_year, count(*) AS captures FROM c GROUP BY 1"),
        "q04_index_rows_per_year": x('SELECT crawl_year, count(*) AS "rows" FROM p GROUP BY 1'),
        "q05_host_year_counts": w("SELECT host, crawl_year, count(*) AS n FROM c GROUP BY 1, 2"),
        "q06_surtkey_year_counts": w("SELECT surtkey, crawl_year, count(*) AS n FROM c GROUP BY 1, 2"),
        "q07_surt_sample": w('SELECT host, surthost, surthost_seg_0 AS tld, surthost_seg_1 AS reg_dom, surthost_seg_2 AS sub1, surthost_seg_3 AS sub2, surtpath_1, surtpath_2 FROM c ORDER BY surtkey, fetch_timestamp, url, "offset" LIMIT 8'),
        "q08_domain_summary": _summary("(surthost_seg_1 || '.' || surthost_seg_0)", "COALESCE(surthost_seg_2, '')"),
        "q08_domain_summary_full": _summary("reg_domain", "sub_full"),
        "q09_subdomain_breakdown": _pivot(f"{_SUB} AS subdomain", "surtkey IS NOT NULL", _wide_total_order("subdomain", 30)),
        "q09_subdomain_breakdown_full": _pivot("CASE WHEN sub_full = '' THEN '(bare/www)' ELSE sub_full END AS subdomain", "surtkey IS NOT NULL", _wide_total_order("subdomain", 20)),
        "q10_unique_subdomains": w(f"SELECT count(DISTINCT {_SUB}) AS n FROM c WHERE surtkey IS NOT NULL"),
        "q11_domain_ranking": w(f"SELECT {_OR_OTHER} AS base_domain, count(*) AS captures FROM c GROUP BY 1"),
        "q12_top_subdomains": _top_per(f"{_OR_OTHER} AS base_domain; CASE WHEN sub_full = '' THEN '(bare)' ELSE sub_full END AS subdomain", "1, 2", "captures", "PARTITION BY base_domain", "subdomain", 10, f"reg_domain IN ({_LIST})"),
        "q13_domain_year_table": w(f"SELECT {_OR_OTHER} AS base_domain, {_years(total=False)} FROM c GROUP BY 1"),
        "q14_status_distribution": w("SELECT status, count(*) AS captures, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM c GROUP BY 1"),
        "q15_status_classes": w("SELECT base_domain, " + ", ".join(f"round_even(CAST(count(*) FILTER (WHERE cls = '{k}') AS DOUBLE) / count(*) * 100 * 10, 0) / 10 AS \"{k}\"" for k in ("2xx", "3xx", "4xx", "5xx", "other")) + f" FROM (SELECT {_OR_OTHER} AS base_domain, {_CLASSES} AS cls FROM c) GROUP BY 1"),
        "q16_mime_distribution": w("SELECT COALESCE(mime, '(null)') AS mime, count(*) AS captures, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM c GROUP BY 1 ORDER BY captures DESC, 1 LIMIT 20"),
        "q17_mime_mismatch": w("SELECT count(*) AS total, count(*) FILTER (WHERE mime <> mime_detected) AS mismatched, round(100.0 * count(*) FILTER (WHERE mime <> mime_detected) / count(*), 2) AS mismatch_pct FROM c WHERE mime IS NOT NULL AND mime_detected IS NOT NULL"),
        "q18_size_statistics": w(_SIZE),
        "q19_digest_duplication": w(f"SELECT {_OR_OTHER} AS base_domain, count(*) AS total_captures, count(DISTINCT digest) AS unique_digests, round(100.0 * (1 - CAST(count(DISTINCT digest) AS DOUBLE) / count(*)), 1) AS duplication_pct FROM c WHERE digest IS NOT NULL GROUP BY 1"),
        "q20_digest_duplication_overall": w("SELECT count(*) AS total_captures, count(DISTINCT digest) AS unique_digests, round(100.0 * (1 - CAST(count(DISTINCT digest) AS DOUBLE) / count(*)), 1) AS duplication_pct FROM c WHERE digest IS NOT NULL"),
        "q21_captures_per_month": w("SELECT crawl_year, substr(fetch_timestamp, 1, 6) AS yyyymm, count(*) AS captures FROM c WHERE fetch_timestamp IS NOT NULL AND length(fetch_timestamp) >= 6 GROUP BY 1, 2"),
        "q22_total_diff": x("SELECT (SELECT count(*) FROM c) AS cdxj_rows, (SELECT count(*) FROM p) AS parquet_rows, (SELECT count(*) FROM p) - (SELECT count(*) FROM c) AS diff"),
        "q23_year_diff": _year_diff(False),
        "q23_year_diff_filled": _year_diff(True),
        "q24_year_domain_diff": x(f", {_YEAR_DOMAIN} SELECT * FROM yd"),
        "q25_year_summary": x(f", {_YEAR_DOMAIN} SELECT *, round_even(100.0 * diff / cdxj_rows * 100, 0) / 100 AS pct_diff FROM (SELECT crawl_year, CAST(COALESCE(sum(parquet_rows), 0) AS BIGINT) AS parquet_rows, CAST(COALESCE(sum(cdxj_rows), 0) AS BIGINT) AS cdxj_rows, CAST(sum(diff) AS BIGINT) AS diff FROM yd GROUP BY 1)"),
        "q26_domain_diff": _gap("base_domain"),
        "q27_domain_year_gaps": _gap("base_domain, crawl_year", "diff <> 0"),
        "q28_subset_breakdown": x(f'SELECT subset, count(*) AS "rows" FROM p WHERE {_P_TARGET} IS NOT NULL GROUP BY 1'),
        "q29_duplicate_rows": x(", both_sides AS (SELECT 'CDXJ' AS source, url, digest FROM c UNION ALL SELECT 'parquet', url, content_digest FROM p WHERE target IS NOT NULL), versions AS (SELECT source, url, COALESCE(digest, '') AS digest, count(*) AS n FROM both_sides GROUP BY ALL) SELECT source, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) - count(url) AS BIGINT) AS duplicate_rows FROM versions GROUP BY 1"),
        "q30_outside_targets": x(f'SELECT url_host_name, url_host_registered_domain, count(*) AS "rows" FROM p WHERE url_surtkey IS NOT NULL AND {_P_TARGET} IS NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20'),
        "q31_domain_year_matrix": _MATRIX_SQL,
        "q31_domain_year_long": x(f", {_MATRIX} SELECT domain, source, year, n FROM long"),
        "q32_split_report": x(f", {_MATRIX} SELECT {_FOLDER} AS folder, CAST(sum(n) FILTER (WHERE source = 'CDXJ') AS BIGINT) AS cdxj_rows, CAST(sum(n) FILTER (WHERE source = 'parquet') AS BIGINT) AS parquet_rows, CAST(sum(CASE source WHEN 'parquet' THEN n ELSE -n END) AS BIGINT) AS diff FROM grid GROUP BY domain"),
        "q38_paths_seen_in": w(f"""SELECT seg1, "2004", "2008", total FROM (SELECT {_SEG1} AS seg1, {_years()} FROM c GROUP BY 1) WHERE "2004" + "2008" > 0"""),
        "q38_paths_seen_in_one_year": w(f"""SELECT seg1, "2016", total FROM (SELECT {_SEG1} AS seg1, {_years()} FROM c GROUP BY 1) WHERE "2016" > 0"""),
        "q39_extensions": _pivot(f"{_EXT_LABEL} AS ext"),
        "q40_filenames": _pivot(f"COALESCE(NULLIF({_NAME}, ''), '(root)') AS filename"),
        "q41_top_subdomains_by_year": _top_subs(),
        "q42_path_heat": w(f"SELECT seg1, {_YEAR_COLS}, " + ", ".join(f'round(ln(1 + "{y}"), 9) AS log_{y}' for y in YEARS) + f" FROM (SELECT {_SEG1} AS seg1, {_years()} FROM c GROUP BY 1 HAVING seg1 <> '(root)' ORDER BY total DESC, seg1 LIMIT 15)"),
        "q43_path_churn": _churn(),
        "q44_path_churn_all_periods": _churn_all(),
        "q45_extension_totals": _rest(10),
        "q45_extension_totals_top2": _rest(2),
        "q46_extension_shift": w(f"SELECT ext, {_YEAR_COLS} FROM (SELECT {_EXT_LABEL} AS ext, {_years()} FROM c GROUP BY 1 HAVING ext <> '(none)' ORDER BY total DESC, ext LIMIT 10)"),
        "q47_top_paths": w(f"SELECT {_SEG1} AS seg1, count(*) AS n FROM c GROUP BY 1 HAVING seg1 <> '(root)' ORDER BY n DESC, seg1 LIMIT 20"),
        "q47_top_paths_per_year": _top_per(f"crawl_year; {_SEG1} AS seg1", "1, 2", "n", "PARTITION BY crawl_year", "seg1", 20),
        "q48_pdf_per_year": w(f"SELECT crawl_year, count(*) AS n FROM c WHERE {_EXT} = 'pdf' GROUP BY 1"),
        "q49_path_depth": _depth(),
        "q50_clean_urls": _clean(),
        "q51_pdf_names": _pivot(f"{_PDF} AS pdf_name", f"{_EXT} = 'pdf'"),
        "q51_unique_pdf_names": w(f"SELECT count(DISTINCT {_PDF}) AS unique_names FROM c WHERE {_EXT} = 'pdf'"),
        "q52_node_ids": _nodes(),
        "q53_mime_by_extension": w(f"SELECT mime, {_EXT_LABEL} AS ext, count(*) AS n FROM c GROUP BY 1, 2"),
        "q54_duplication": w(f", {_DUP} SELECT * FROM dup"),
        "q54_total_true_duplicates": w(f", {_DUP} SELECT CAST(sum(true_duplicates) AS BIGINT) AS true_duplicates, count(*) FILTER (WHERE true_duplicates > 0) AS cells_with_duplicates FROM dup"),
        "q55_redundancy_heat": w(f", {_DUP} SELECT domain, " + ", ".join(f"COALESCE(sum(redundancy_pct) FILTER (WHERE crawl_year = '{y}'), 0.0) AS \"{y}\"" for y in YEARS) + " FROM dup GROUP BY 1"),
        "q56_unique_heat": w(f", {_DUP} SELECT domain, " + ", ".join(f"CAST(COALESCE(sum(unique_surturls) FILTER (WHERE crawl_year = '{y}'), 0) AS BIGINT) AS \"{y}\"" for y in YEARS) + " FROM dup GROUP BY 1"),
        "q57_most_captured": _top_per("target AS domain; surtkey; crawl_year", "1, 2, 3", "captures", "PARTITION BY domain", "surtkey, crawl_year", 10, "target IS NOT NULL"),
        "q57_most_captured_overall": w("SELECT domain, crawl_year, surtkey, captures FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY captures DESC, surtkey, crawl_year) AS r FROM (SELECT target AS domain, surtkey, crawl_year, count(*) AS captures FROM c WHERE target IS NOT NULL GROUP BY 1, 2, 3)) WHERE r <= 10 ORDER BY captures DESC, domain, surtkey, crawl_year LIMIT 20"),
        "q58_year_overlap": w(f", {_OVERLAP} SELECT * FROM overlap"),
        "q58_year_overlap_pct": w(f", {_OVERLAP} SELECT domain, " + ", ".join(f'CAST("{i} year(s)" AS DOUBLE) / total_unique_surts * 100 AS "{i} year(s)"' for i in range(1, 7)) + " FROM overlap"),
        "q59_dns_share": w("SELECT *, round_even(100.0 * dns_records / total_records * 10000, 0) / 10000 AS dns_pct FROM (SELECT target AS domain, count(*) FILTER (WHERE mime = 'text/dns') AS dns_records, count(*) AS total_records FROM c WHERE target IS NOT NULL GROUP BY 1)"),
        "q60_dns_sample": w(f'SELECT url, host, fetch_timestamp, status, "length" FROM c WHERE {_DNS} ORDER BY fetch_timestamp, url, host, "length", "offset" LIMIT 20'),
        "q61_dns_totals": w(f"SELECT count(*) AS total_dns_records, count(DISTINCT url) AS unique_dns_urls, count(DISTINCT host) AS unique_hosts FROM c WHERE {_DNS}"),
        "q62_dns_top_hosts": w(f"SELECT host, count(*) AS n FROM c WHERE {_DNS} GROUP BY 1 ORDER BY n DESC, host LIMIT 30"),
        "q63_dns_repeats": w(f", class(low, high, occurrences_per_host) AS (VALUES (1, 1, '1 (seen once)'), (2, 5, '2-5'), (6, 20, '6-20'), (21, 1000000000000, '20+')), per_host AS (SELECT host, count(*) AS n FROM c WHERE {_DNS} GROUP BY 1) SELECT occurrences_per_host, count(*) AS host_count, CAST(sum(n) AS BIGINT) AS total_dns_records FROM per_host JOIN class ON n BETWEEN low AND high GROUP BY 1"),
        "q64_index_second_label": x("SELECT url_host_2nd_last_part, count(*) AS url_count FROM p GROUP BY 1"),
        "q65_index_private_suffix": x("SELECT url_host_private_suffix, count(*) AS url_count FROM p GROUP BY 1"),
        "q66_index_not_found": x("SELECT url_surtkey, fetch_status FROM p WHERE fetch_status = 404"),
        "q67_domain_hosts": w(f"SELECT {_HOST_LABEL} AS base_domain, h AS host, count(*) AS captures FROM (SELECT {_PLAIN_HOST} AS h FROM c) WHERE {_HOST_LABEL} IS NOT NULL GROUP BY 1, 2"),
        "q68_host_first_paths": w(f"SELECT h AS host, path1, count(*) AS captures FROM (SELECT {_PORT_HOST} AS h, {_FIRST} AS path1 FROM c) WHERE h = 'example.com' OR ends_with(h, '.example.com') GROUP BY 1, 2"),
        "q69_domain_host_paths": w(f"SELECT {_HOST_LABEL} AS base_domain, h AS host, path1, count(*) AS captures FROM (SELECT {_PORT_HOST} AS h, {_FIRST} AS path1 FROM c) WHERE {_HOST_LABEL} IS NOT NULL GROUP BY 1, 2, 3"),
        "q70_domain_host_two_paths": w(f"SELECT {_HOST_LABEL} AS base_domain, h AS host, path2, count(*) AS captures FROM (SELECT {_PORT_HOST} AS h, {_TWO} AS path2 FROM c) WHERE {_HOST_LABEL} IS NOT NULL GROUP BY 1, 2, 3"),
        "q71_url_contains": w("SELECT count(*) AS n FROM c WHERE lower(url) LIKE '%example.com%'"),
        "q72_parse_errors": with_errors("SELECT file, line, error_type, CASE error_type WHEN 'ValueError' THEN 'not enough values to unpack (expected 3, got ' || tokens || ')' WHEN 'TypeError' THEN 'third token is JSON but not an object' WHEN 'JSONDecodeError' THEN 'third token is not one JSON object' ELSE 'status, length or offset is not an integer' END AS error_message, substr(raw_text, 1, 200) AS raw_line_preview FROM errors"),
        "q72_error_types": with_errors('SELECT error_type, count(*) AS "count" FROM errors GROUP BY 1'),
        "q73_distinct_values": w("SELECT " + ", ".join(f"count(DISTINCT {k}) AS {k}" for k in _CAPTURE_COLUMNS) + " FROM c"),
        "q74_pending_files": f"WITH {_PENDING} SELECT (SELECT count(*) FROM want) AS files, (SELECT count(*) FROM todo) AS pending, (SELECT count(*) FROM want) - (SELECT count(*) FROM todo) AS skipped, (SELECT CAST(COALESCE(sum(size), 0) AS BIGINT) FROM todo) AS pending_bytes",
        "q34_path_prefixes_2_root": _prefixes(2, "(root)"),
    }
    for d in range(1, 6):
        q[f"q{32 + d}_path_prefixes_{d}"] = _prefixes(d)
    return q


def _others() -> dict[str, str]:
    w, x = with_captures, with_index
    all_columns = ", ".join(_CAPTURE_COLUMNS)
    per_cell = "SELECT crawl_year, {bd} AS base_domain, count(*) AS n, count(DISTINCT surtkey) AS keys FROM c WHERE {where} GROUP BY 1, 2"
    targets = per_cell.format(bd="target", where="target IS NOT NULL")
    # redelivered lines of the same capture count once
    unseen = """, u AS (SELECT surtkey, crawl_year, target FROM c WHERE target IS NOT NULL)
SELECT crawl_year, target AS base_domain, count(*) AS n, count(DISTINCT surtkey) AS keys FROM u GROUP BY 1, 2"""
    host = "SELECT surthost, count(*) AS n FROM c WHERE target IS NULL AND surtkey IS NOT NULL GROUP BY 1"
    backfilled = """, u AS (
  SELECT surtkey, crawl_year, target FROM c WHERE target IS NOT NULL AND mime IS DISTINCT FROM 'text/dns'
  UNION ALL
  SELECT surtkey, crawl_year, target FROM c WHERE target IS NOT NULL AND mime = 'text/dns')
SELECT crawl_year, target AS base_domain, count(*) AS n, count(DISTINCT surtkey) AS keys FROM u GROUP BY 1, 2"""
    derived = f"""reg_domain, sub_full, {_EXT} AS ext, {_NAME} AS filename, {_PDF} AS pdf_name,
  CAST({_DEPTH} AS INTEGER) AS depth"""
    return {
        "src_cdxj_load": w(f"SELECT {all_columns} FROM c WHERE target IS NOT NULL"),
        "src_cdxj_convert": w("""SELECT url, mime, CAST(status AS VARCHAR) AS status, digest, CAST("length" AS VARCHAR) AS "length",
  CAST("offset" AS VARCHAR) AS "offset", warc_filename AS filename, mime_detected, puid, charset, languages, surtkey,
  fetch_timestamp AS timestamp FROM c
  UNION ALL
  SELECT url, NULL, '-', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, surtkey, fetch_timestamp
  FROM c WHERE status = 301 AND event_id % 6 = 4"""),
        "src_dns_lines": w("""SELECT url, host, surtkey, fetch_timestamp, crawl_year, "length" FROM c WHERE mime = 'text/dns' AND target IS NOT NULL"""),
        "src_index_year_from_file": x('SELECT crawl_year, count(*) AS "rows" FROM p GROUP BY 1'),
        "src_index_named_years": x("""SELECT crawl_year, subset, count(*) AS "rows" FROM p WHERE crawl_year IN ('2004', '2020') GROUP BY 1, 2"""),
        "src_index_partition_key": x("""SELECT fetch_status, count(*) AS "rows" FROM p WHERE crawl_year = '2020' GROUP BY 1"""),
        "src_index_file_listing": x("SELECT crawl_year, count(*) > 0 AS has_files, count(*) > 0 AS has_bytes FROM p GROUP BY 1"),
        "src_manifest": "SELECT 'crawl-data/' || md5(url) || '.cdxj.gz' AS key, CAST(NULL AS BIGINT) AS size FROM pages",
        "src_pending": f"WITH {_PENDING} SELECT key, size FROM todo",
        "prj_url_parts": w(f"""SELECT event_id, url, host, url_path, url_query, {', '.join(f'path_seg_{i}' for i in range(1, 6))},
  {_PLAIN_HOST} AS authority_host, {_PORT_HOST} AS host_and_port, {_FIRST} AS path1, {_TWO} AS path2 FROM c"""),
        "prj_surt_parts": w(f"""SELECT event_id, surtkey, surthost, {', '.join(f'surthost_seg_{i}' for i in range(6))},
  {', '.join(f'surtpath_{i}' for i in range(1, 6))}, {derived}, surthost_seg_0 AS tld, target AS by_surt,
  CASE WHEN target = 'example.com' THEN target END AS by_prefix, {_NUMBER} AS path_number FROM c"""),
        "prj_label_from_dimension": w(f"SELECT target AS domain, {_FOLDER.replace('CASE domain', 'CASE target')} AS folder, count(*) AS n FROM c WHERE target IS NOT NULL GROUP BY 1, 2"),
        "flt_outside_targets": w(host),
        "agg_status_share_by_year": w("SELECT crawl_year, status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS pct FROM c GROUP BY 1, 2"),
        "snk_load_years": w(per_cell.format(bd="target", where="target IS NOT NULL AND crawl_year IN ('2016', '2020')")),
        "snk_split_by_domain": w("SELECT target AS base_domain, count(*) AS n FROM c WHERE target IS NOT NULL GROUP BY 1"),
        "snk_split_index": x(f"SELECT 'example.com' AS base_domain, subset, count(*) AS n FROM p WHERE {_P_TARGET} = 'example.com' GROUP BY 1, 2"),
        "snk_migrate_surt_columns": w(f"SELECT surthost, {', '.join(f'surthost_seg_{i}' for i in range(6))}, {', '.join(f'surtpath_{i}' for i in range(1, 6))}, count(*) AS n FROM c GROUP BY ALL"),
        "snk_load_replace": w(per_cell.format(bd="target", where="target = 'example.com' AND crawl_year IN ('2016', '2020') OR target IS NOT NULL AND crawl_year = '2012'")),
        "snk_load_absent_year": w(per_cell.format(bd="target", where="target IS NOT NULL AND crawl_year = '2020'")),
        "snk_load_quarantine": with_errors('SELECT error_type, count(*) AS "count" FROM errors GROUP BY 1'),
        "str_stream_quarantine": with_errors('SELECT error_type, count(*) AS "count" FROM errors GROUP BY 1'),
        "snk_report_base_refreshed": w(f"""SELECT crawl_year, base_domain, count(*) AS n, CAST(sum(k) AS BIGINT) AS captures
FROM (SELECT crawl_year, target AS base_domain, surthost_seg_2, {', '.join(f'surtpath_{i}' for i in range(1, 6))}, {_EXT} AS e, {_DEPTH} AS d, mime, count(*) AS k
      FROM c WHERE target IS NOT NULL AND crawl_year IN ('2008', '2012', '2020') OR target = 'example.com' AND crawl_year = '2016'
      GROUP BY ALL) GROUP BY 1, 2"""),
        "snk_size_histogram_refreshed": w(_SIZE.replace("> 0 GROUP", "> 0 AND (target IS NOT NULL AND crawl_year = '2020' OR target = 'example.com' AND crawl_year = '2016') GROUP")),
        "snk_propagate_dns_all": w("SELECT target AS base_domain, mime, count(*) AS n FROM c WHERE target IS NOT NULL GROUP BY 1, 2"),
        "snk_propagate_dns_counts": w("""SELECT target AS base_domain, count(*) FILTER (WHERE mime = 'text/dns') AS "rows" FROM c WHERE target IS NOT NULL GROUP BY 1"""),
        "snk_split_key_ranges": w("SELECT target AS base_domain, count(*) AS n, count(*) > 200 AS several_files, CAST(0 AS BIGINT) AS overlaps FROM c WHERE target IS NOT NULL GROUP BY 1"),
        "snk_load_index": x("SELECT crawl_year, COALESCE(target, 'other') AS base_domain, subset, count(*) AS n FROM p GROUP BY ALL"),
        "snk_load_index_counts": x('SELECT crawl_year, count(*) AS "rows" FROM p GROUP BY 1'),
        "snk_load_index_evolved": x("""SELECT crawl_year, COALESCE(target, 'other') AS base_domain, count(*) AS n,
  count(subset) FILTER (WHERE crawl_year <> '2004') AS subsets,
  count(*) FILTER (WHERE crawl_year = '2008' AND subset = 'warc') AS noted,
  CAST(sum(CASE WHEN crawl_year = '2012' THEN 10000000000 * CAST(fetch_status AS BIGINT) ELSE fetch_status END) AS BIGINT) AS statuses
FROM p WHERE crawl_year IN ('2004', '2008', '2012') GROUP BY ALL"""),
        "src_index_file_count": w("SELECT count(*) AS files FROM (SELECT DISTINCT crawl_year, event_id // 50000 FROM raw)"),
        "prj_label_any_depth": w(f""", nested(d, stem) AS (VALUES {_NESTED}),
hit AS (SELECT event_id, arg_max(d, length(n.stem)) AS domain FROM c LEFT JOIN nested n
        ON starts_with(translate(surtkey, ':)', ',,'), n.stem) GROUP BY event_id)
SELECT domain, count(*) AS n FROM hit GROUP BY 1"""),
        "snk_load_interrupted": w(per_cell.format(bd="target", where="target IS NOT NULL AND crawl_year IN ('2016', '2020')")),
        "snk_load_counts": w("""SELECT 0 AS run, count(*) AS "rows" FROM c WHERE target IS NOT NULL AND crawl_year IN ('2016', '2020')
UNION ALL SELECT 1, count(*) FROM c WHERE target = 'example.com' AND crawl_year = '2020'
UNION ALL SELECT 2, count(*) FROM c WHERE target IS NOT NULL AND crawl_year = '2004'"""),
        "snk_load_quarantine_repeated": with_errors("""SELECT regexp_extract(file, 'CRAWL-([0-9]+)', 1) AS crawl_year, error_type,
  count(*) AS n, CAST(sum(line) AS BIGINT) AS lines FROM errors GROUP BY 1, 2"""),
        "str_lost_checkpoint": w(targets),
        "str_unseen_lost_checkpoint": w(targets),
        "str_half_batch": w(targets),
        "str_unseen_without_years": w("SELECT CAST(NULL AS VARCHAR) AS crawl_year, target AS base_domain, count(*) AS n, count(DISTINCT surtkey) AS keys FROM c WHERE target IS NOT NULL GROUP BY 1, 2"),
        "snk_backfill_interrupted": w(targets),
        "str_stream_then_append": w(per_cell.format(bd="COALESCE(target, 'other')", where="true")),
        "snk_structure_path_heat": w(f"SELECT base_domain, seg1, {_YEAR_COLS}, " + ", ".join(f'round(ln(1 + "{y}"), 9) AS log_{y}' for y in YEARS) + f" FROM (SELECT *, row_number() OVER (PARTITION BY base_domain ORDER BY total DESC, seg1) AS r FROM (SELECT {_BD}, {_SEG1} AS seg1, {_years()} FROM c GROUP BY 1, 2) WHERE seg1 <> '(root)') WHERE r <= 15"),
        "snk_backfill_dns": w(backfilled),
        "snk_propagate_dns": w("SELECT crawl_year, mime, count(*) AS n FROM c WHERE target = 'example.com' GROUP BY 1, 2"),
        "snk_csv_export": _MATRIX_SQL,
        "snk_materialised_view": w(f"SELECT {_PORT_HOST} AS host, count(*) AS n FROM c GROUP BY 1"),
        "str_load_new_files": w(targets),
        "str_append_unseen": w(unseen),
        "snk_structure_subdomains": _limited_per_domain(w(f"SELECT {_BD}, {_SUB} AS subdomain, {_years()} FROM c GROUP BY 1, 2"), "subdomain", f"base_domain, subdomain, {_YEAR_COLS}, total"),
        "snk_structure_subdomain_years": _top_subs("base_domain"),
        "snk_structure_extension_totals": _rest(10, "base_domain"),
        "snk_structure_path_churn": w(f""", {_CHURN_BASE.format(keys=_BD + ', ')},
f AS (SELECT base_domain, seg1, bool_or(crawl_year = '2020') AS a, bool_or(crawl_year = '2024') AS b FROM seen GROUP BY 1, 2)
SELECT base_domain, 'Only in 2020' AS category, count(*) FILTER (WHERE a AND NOT b) AS "count" FROM f GROUP BY 1
UNION ALL SELECT base_domain, 'In both', count(*) FILTER (WHERE a AND b) FROM f GROUP BY 1
UNION ALL SELECT base_domain, 'Only in 2024', count(*) FILTER (WHERE b AND NOT a) FROM f GROUP BY 1"""),
        "snk_structure_path_depth": _depth("base_domain"),
        "snk_structure_clean_urls": _clean("base_domain"),
        "snk_structure_node_ids": _nodes("base_domain"),
        **{
            f"snk_structure_path_prefixes_{d}": _limited_per_domain(
                _prefixes(d, None, "base_domain"),
                ", ".join(f"seg{i}" for i in range(1, d + 1)),
                f"base_domain, {', '.join(f'seg{i}' for i in range(1, d + 1))}, {_YEAR_COLS}, total",
            )
            for d in range(1, 6)
        },
        "snk_structure_summary": w(f"SELECT {_BD}, count(*) AS captures, count(DISTINCT crawl_year) AS years, min(crawl_year) AS first_year, max(crawl_year) AS last_year FROM c GROUP BY 1"),
        "snk_structure_unique_subdomains": w(f"SELECT {_BD}, count(DISTINCT {_SUB}) AS n FROM c GROUP BY 1"),
        "snk_structure_unique_pdf_names": w(f"SELECT {_BD}, count(DISTINCT {_PDF}) AS unique_names FROM c WHERE {_EXT} = 'pdf' GROUP BY 1"),
        "snk_structure_captures_per_year": _per_domain("crawl_year, count(*) AS captures"),
        "snk_structure_host_years": _per_domain("host, crawl_year, count(*) AS n"),
        "snk_structure_pdf_per_year": _per_domain("crawl_year, count(*) AS n", f"{_EXT} = 'pdf'"),
        "snk_structure_mime_by_extension": _per_domain(f"mime, {_EXT_LABEL} AS ext, count(*) AS n"),
        "snk_structure_extensions": _limited_per_domain(
            _per_domain(f"{_EXT_LABEL} AS ext, {_years()}"), "ext", f"base_domain, ext, {_YEAR_COLS}, total"
        ),
        "snk_structure_pdf_names": _limited_per_domain(
            _per_domain(f"{_PDF} AS pdf_name, {_years()}", f"{_EXT} = 'pdf'"),
            "pdf_name",
            f"base_domain, pdf_name, {_YEAR_COLS}, total",
        ),
        "snk_structure_extension_shift": _limited_per_domain(
            _per_domain(f"{_EXT_LABEL} AS ext, {_years()}", f"{_EXT} <> ''"),
            "ext",
            f"base_domain, ext, {_YEAR_COLS}",
            10,
        ),
        "snk_structure_top_paths": _ranked_paths("base_domain", "", f"{_SEG1} <> '(root)'"),
        "snk_structure_top_paths_per_year": _ranked_paths("base_domain, crawl_year", "crawl_year, "),
        "snk_structure_path_churn_all_periods": w(f""", {_CHURN_BASE.format(keys=_BD + ', ')},
f AS (SELECT base_domain, seg1, list(crawl_year) AS ys FROM seen GROUP BY 1, 2),
pairs AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in zip(YEARS, YEARS[1:]))}) v(a, b))
SELECT base_domain, a || '→' || b AS period,
  count(*) FILTER (WHERE list_contains(ys, a) AND NOT list_contains(ys, b)) AS "Disappeared",
  count(*) FILTER (WHERE list_contains(ys, a) AND list_contains(ys, b)) AS "Persisted",
  count(*) FILTER (WHERE list_contains(ys, b) AND NOT list_contains(ys, a)) AS "New"
FROM f, pairs GROUP BY 1, 2"""),
        "snk_structure_filenames": _limited_per_domain(w(f"SELECT {_BD}, COALESCE(NULLIF({_NAME}, ''), '(root)') AS filename, {_years()} FROM c GROUP BY 1, 2"), "filename", f"base_domain, filename, {_YEAR_COLS}, total"),
    }


def oracle_sql() -> dict[str, str]:
    return {**_reports(), **_others()}

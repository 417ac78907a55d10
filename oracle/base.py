"""SQL views of the derived archive: raw records, captures, index and capture lines."""

from __future__ import annotations

YEARS = ("2004", "2008", "2012", "2016", "2020", "2024")
DOMAINS = ("example.com", "example.net")

_RAW = r"""
page AS (
  SELECT page_id, url AS page_url,
         regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin,
         lower(regexp_extract(url, '^[a-z]+:(?://)?([^/?#:]+)', 1)) AS page_host,
         md5(html) AS page_digest,
         CAST(length(html) AS BIGINT) AS page_length,
         regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) AS lang
  FROM pages),
visit AS (
  SELECT e.event_id, e.user_id, e.event_type, e.ts, p.*,
         e.event_type = 'error' AND e.user_id % 5 = 0 AS is_dns,
         e.event_type = 'view' AND e.user_id % 10 = 3 AS has_port,
         CAST(2004 + 4 * (5 - e.user_id % (1 + p.page_id % 6)) AS VARCHAR) AS crawl_year
  FROM events e JOIN page p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)),
named AS (
  SELECT *, CASE
      WHEN is_dns THEN 'dns:' || page_host
      WHEN event_type = 'purchase' THEN origin || '/docs/' || crawl_year || '/reports/q'
           || (user_id % 4) || '/report_' || (event_id % 50) || '.pdf'
      WHEN event_type = 'signup' THEN origin || '/node/' || page_id
      WHEN event_type = 'error' THEN origin || '/Missing/' || user_id
      WHEN has_port THEN origin || ':8080' || substr(page_url, length(origin) + 1)
      ELSE page_url END AS url
  FROM visit),
pathed AS (
  SELECT *, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS p,
         lower(regexp_extract(url, '[?]([^#]*)', 1)) AS q
  FROM named),
raw AS (
  SELECT event_id, url, crawl_year,
    CASE WHEN is_dns THEN 'text/dns' WHEN event_type = 'purchase' THEN 'application/pdf'
         WHEN event_type <> 'view' THEN 'text/html' END AS mime,
    CASE WHEN is_dns THEN NULL WHEN event_type = 'error' AND user_id % 2 = 0 THEN 503
         WHEN event_type = 'error' THEN 404 WHEN event_type = 'signup' THEN 301 ELSE 200 END AS status,
    CASE WHEN event_type <> 'signup' THEN page_digest END AS digest,
    CAST(CASE WHEN is_dns THEN length(page_host) + 60 WHEN event_type = 'signup' THEN 0
         ELSE page_length + user_id % 7 END AS BIGINT) AS "length",
    event_id * 1000 AS "offset",
    'crawl-' || crawl_year || '-' || (user_id % 20) || '.warc.gz' AS warc_filename,
    CASE WHEN is_dns THEN NULL WHEN event_type = 'purchase' THEN 'application/pdf'
         WHEN event_type = 'click' AND user_id % 4 = 0 THEN 'application/xhtml+xml'
         ELSE 'text/html' END AS mime_detected,
    CASE WHEN event_type = 'purchase' THEN 'fmt/276' END AS puid,
    CASE WHEN NOT is_dns AND event_type NOT IN ('purchase', 'view') THEN 'UTF-8' END AS charset,
    NULLIF(lang, '') AS languages,
    array_to_string(list_reverse(string_split(regexp_replace(page_host, '^www[0-9]*[.]', ''), '.')), ',')
      || CASE WHEN has_port THEN ':8080' ELSE '' END || ')'
      || CASE WHEN is_dns OR p IN ('', '/') THEN '/' ELSE regexp_replace(lower(p), '/$', '') END
      || CASE WHEN NOT is_dns AND q <> '' THEN '?' || q ELSE '' END AS surtkey,
    crawl_year || CASE WHEN user_id % 2 = 0 THEN '01' ELSE '03' END
      || strftime(ts, '%d%H') || '0000' AS fetch_timestamp
  FROM pathed)"""


#: The captures' path and its parts, as columns of ``c``.
SP = "sp"
_STEMS = ", ".join(f"('{d}', '{','.join(reversed(d.split('.')))},')" for d in DOMAINS)


def _items(array: str, names: list[str]) -> str:
    return ", ".join(f"{array}[{i}] AS {name}" for i, name in enumerate(names, 1))


_CAPTURES = f"""
dimension(target, stem) AS (VALUES {_STEMS}),
parts AS (
  SELECT *, lower(regexp_extract(url, '^[a-z]+:(?://)?([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS url_path,
         substr(url, nullif(strpos(url, '?'), 0) + 1) AS after_mark,
         split_part(surtkey, ')', 1) AS surthost,
         split_part(substr(surtkey, strpos(surtkey, ')') + 1), '?', 1) AS sp
  FROM raw),
arrays AS (
  SELECT *, COALESCE(after_mark, '') AS url_query, string_split(trim(url_path, '/'), '/') AS url_parts,
         string_split(surthost, ',') AS labels, string_split(trim(sp, '/'), '/') AS path_parts
  FROM parts),
c AS (
  SELECT arrays.*, target,
    {_items('url_parts', [f'path_seg_{i}' for i in range(1, 6)])},
    {_items('labels', [f'surthost_seg_{i}' for i in range(6)])},
    {_items('path_parts', [f'surtpath_{i}' for i in range(1, 6)])},
    CASE WHEN len(labels) > 1 THEN labels[2] || '.' || labels[1] END AS reg_domain,
    COALESCE(array_to_string(list_reverse(labels[3:]), '.'), '') AS sub_full
  FROM arrays LEFT JOIN dimension ON starts_with(translate(surtkey, ':)', ',,'), stem))"""

_INDEX = """
p AS (
  SELECT url, surtkey AS url_surtkey, target, host AS url_host_name,
    array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS url_host_registered_domain,
    string_split(host, '.')[-2] AS url_host_2nd_last_part,
    string_split(host, '.')[-1] AS url_host_private_suffix,
    status AS fetch_status, digest AS content_digest,
    CASE WHEN status = 200 THEN 'warc' ELSE 'cdx' END AS subset, crawl_year
  FROM c WHERE crawl_year <> '2024' AND mime IS DISTINCT FROM 'text/dns')"""

_LINES = """
bad_text AS (
  SELECT event_id, 1 AS part, crawl_year, event_id // 50000 AS shard,
    CASE event_id % 6
      WHEN 0 THEN surtkey
      WHEN 1 THEN surtkey || ' ' || fetch_timestamp || ' {"url":"' || url || '",'
      WHEN 2 THEN surtkey || ' ' || fetch_timestamp || ' {"url":"' || url || '"} trailing'
      WHEN 3 THEN surtkey || ' ' || fetch_timestamp || ' [1]'
      WHEN 4 THEN surtkey || ' ' || fetch_timestamp || ' {"url":"' || url || '","status":"-"}'
      ELSE '' END AS v
  FROM raw WHERE status = 301),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY crawl_year, shard ORDER BY event_id, part) AS line
  FROM (SELECT event_id, part, crawl_year, shard, v FROM bad_text
        UNION ALL
        SELECT event_id, 0, crawl_year, event_id // 50000, NULL FROM raw)),
bad AS (
  SELECT 'crawl=CRAWL-' || crawl_year || '/shard=' || shard AS file, line, v,
    CASE WHEN v = '' THEN 1 ELSE least(len(string_split(v, ' ')), 3) END AS tokens,
    array_to_string(list_slice(string_split(v, ' '), 3, len(string_split(v, ' '))), ' ') AS blob
  FROM numbered WHERE part = 1),
errors AS (
  SELECT file, line, v AS raw_text,
    CASE WHEN tokens < 3 THEN 'ValueError'
         WHEN NOT json_valid(blob) THEN 'JSONDecodeError'
         WHEN json_type(blob) <> 'OBJECT' THEN 'TypeError'
         ELSE 'ConversionError' END AS error_type,
    tokens
  FROM bad)"""


def with_captures(query: str) -> str:
    """``c``: one row per capture with every derived column."""
    return f"WITH {_RAW},{_CAPTURES}\n{query}"


def with_index(query: str) -> str:
    """``c`` and the Parquet index ``p``."""
    return f"WITH {_RAW},{_CAPTURES},{_INDEX}\n{query}"


def with_errors(query: str) -> str:
    return f"WITH {_RAW},{_LINES}\n{query}"

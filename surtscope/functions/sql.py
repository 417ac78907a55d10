"""The URL and SURT-key functions as SQL functions, for reports written in SQL text.

``register`` creates them in a session; they are macros that Spark expands into the
query, so a filter or projection written with them plans like one written with the
column functions of ``urls``, whose patterns they take.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from surtscope.config import TARGET_DOMAINS
from surtscope.functions import urls


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _extract(column: str, pattern: str) -> str:
    return f"regexp_extract({column}, {_text(pattern)}, 1)"


def _functions(domains) -> dict[str, tuple[str, str, str]]:
    """Name to (parameters, result type, body). Later ones may use earlier ones."""
    listed = ", ".join(f"named_struct('p', {_text(urls.surt_prefix_of(d))}, 'd', {_text(d)})" for d in domains)
    return {
        "url_host": ("url STRING", "STRING", f"lower({_extract('url', urls.HOST)})"),
        "url_authority_host": ("url STRING", "STRING", f"lower({_extract('url', urls.HOST_AUTHORITY_ONLY)})"),
        "url_host_and_port": ("url STRING", "STRING", f"lower({_extract('url', urls.HOST_WITH_PORT)})"),
        "url_path": ("url STRING", "STRING", _extract("url", urls.URL_PATH)),
        "url_query": ("url STRING", "STRING", _extract("url", urls.URL_QUERY)),
        "surt_host": ("surtkey STRING", "STRING", _extract("surtkey", urls.SURT_HOST)),
        "surt_path": ("surtkey STRING", "STRING", _extract("surtkey", urls.SURT_PATH)),
        "surt_parts": ("surtkey STRING", "ARRAY<STRING>", "split(surt_host(surtkey), ',')"),
        "surt_tld": ("surtkey STRING", "STRING", "get(surt_parts(surtkey), 0)"),
        "surt_base_domain": (
            "surtkey STRING",
            "STRING",
            "CASE WHEN size(surt_parts(surtkey)) >= 2"
            " THEN concat(get(surt_parts(surtkey), 1), '.', get(surt_parts(surtkey), 0)) END",
        ),
        "surt_subdomain": (
            "surtkey STRING",
            "STRING",
            "coalesce(array_join(reverse(slice(surt_parts(surtkey), 3,"
            " greatest(size(surt_parts(surtkey)) - 2, 0))), '.'), '')",
        ),
        "path_segment": ("path STRING, place INT", "STRING", "get(split(btrim(path, '/'), '/'), place - 1)"),
        "surt_extension": ("surtkey STRING", "STRING", f"lower({_extract('surt_path(surtkey)', urls.EXTENSION)})"),
        "surt_filename": ("surtkey STRING", "STRING", _extract("surt_path(surtkey)", urls.FILENAME)),
        "surt_pdf_name": ("surtkey STRING", "STRING", _extract("surt_path(surtkey)", urls.PDF_NAME)),
        "surt_path_depth": ("surtkey STRING", "INT", "size(split(btrim(surt_path(surtkey), '/'), '/'))"),
        "label_if_empty": ("value STRING, label STRING", "STRING", "coalesce(nullif(value, ''), label)"),
        "surt_prefix": ("domain STRING", "STRING", "array_join(reverse(split(domain, '[.]')), ',')"),
        "surt_in_domain": (
            "surtkey STRING, domain STRING",
            "BOOLEAN",
            "startswith(surtkey, surt_prefix(domain) || ')') OR startswith(surtkey, surt_prefix(domain) || ':')"
            " OR startswith(surtkey, surt_prefix(domain) || ',')",
        ),
        # the first listed domain that holds the key
        "surt_target_domain": (
            "surtkey STRING",
            "STRING",
            f"get(filter(array({listed}), x -> startswith(surtkey, x.p || ')')"
            " OR startswith(surtkey, x.p || ':') OR startswith(surtkey, x.p || ',')), 0).d",
        ),
    }


def register(spark: SparkSession, domains=TARGET_DOMAINS) -> list[str]:
    """Create the functions in the session; returns their names."""
    functions = _functions(domains)
    for name, (parameters, result, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(functions)

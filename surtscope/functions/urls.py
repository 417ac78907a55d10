"""URL and SURT-key columns.

Every function maps ``Column -> Column`` with built-in expressions, so the
derivation stays inside whole-stage codegen. A SURT key reads
``tld,domain,sub)/path?query``: host labels reversed, then the path.

Patterns end in ``\\z`` because Java's ``$`` also matches before a final
newline. A pattern that does not match yields ``''``; a list index past the
end yields NULL. Both are meaningful: a root page has ``surtpath_1 = ''`` and
``surtpath_2`` NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtscope.config import PATH_DEPTH, SURT_HOST_DEPTH, SURT_PATH_DEPTH

# Patterns that decide what counts as host, path and query.
HOST = r"^[a-z]+:(?://)?([^/?#:]+)"
HOST_AUTHORITY_ONLY = r"^[a-z]+://([^/?#:]+)"
HOST_WITH_PORT = r"^[a-z]+://([^/]+)"
URL_PATH = r"^[a-z]+://[^/]+(/[^?#]*)"
URL_QUERY = r"(?d)\?(.*)\z"
SURT_HOST = r"^([^)]+)\)"
SURT_PATH = r"\)([^?]*)"
EXTENSION = r"\.([a-zA-Z0-9]+)\z"
FILENAME = r"/([^/]+)\z"
PDF_NAME = r"/([^/]+\.pdf)\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pieces(c: Column, sep: str) -> Column:
    return F.split(c, sep)


def _path_pieces(path: Column) -> Column:
    return _pieces(F.btrim(path, F.lit("/")), "/")


# --- from the URL -----------------------------------------------------------


def host(url: Column | str) -> Column:
    """Lower-cased host; the authority marker is optional so ``dns:name`` counts."""
    return F.lower(F.regexp_extract(_col(url), HOST, 1))


def authority_host(url: Column | str) -> Column:
    """Host of URLs that have ``://``; the port is dropped."""
    return F.lower(F.regexp_extract(_col(url), HOST_AUTHORITY_ONLY, 1))


def host_and_port(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), HOST_WITH_PORT, 1))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), URL_PATH, 1)


def url_query(url: Column | str) -> Column:
    """Everything after the first ``?``, a fragment included."""
    return F.regexp_extract(_col(url), URL_QUERY, 1)


def path_segment(path: Column | str, position: int) -> Column:
    """Segment ``position`` (1-based) of a path, NULL past the end."""
    return F.get(_path_pieces(_col(path)), F.lit(position - 1))


def first_segment(path: Column | str, root: str = "(root)") -> Column:
    return label_if_empty(path_segment(path, 1), root)


def first_two_segments(path: Column | str, root: str = "(root)") -> Column:
    p = _col(path)
    joined = F.array_join(F.slice(_path_pieces(p), 1, 2), "/")
    return F.when(p.isNull() | p.isin("", "/"), F.lit(root)).otherwise(joined)


# --- from the SURT key ------------------------------------------------------


def surt_host(surtkey: Column | str = "surtkey") -> Column:
    return F.regexp_extract(_col(surtkey), SURT_HOST, 1)


def surt_path(surtkey: Column | str = "surtkey") -> Column:
    """Path part of the key without the query."""
    return F.regexp_extract(_col(surtkey), SURT_PATH, 1)


def surt_host_parts(surtkey: Column | str = "surtkey") -> Column:
    """Host labels, TLD first."""
    return _pieces(surt_host(surtkey), ",")


def surt_host_segment(surtkey: Column | str, position: int) -> Column:
    return F.get(surt_host_parts(surtkey), F.lit(position))


def surt_path_segment(surtkey: Column | str, position: int) -> Column:
    return path_segment(surt_path(surtkey), position)


def tld(surtkey: Column | str = "surtkey") -> Column:
    return F.get(surt_host_parts(surtkey), F.lit(0))


def _registered(labels: Column) -> Column:
    return F.when(
        F.size(labels) >= 2,
        F.concat(F.get(labels, F.lit(1)), F.lit("."), F.get(labels, F.lit(0))),
    )


def _below(labels: Column) -> Column:
    rest = F.slice(labels, F.lit(3), F.greatest(F.size(labels) - 2, F.lit(0)))
    return F.coalesce(F.array_join(F.reverse(rest), "."), F.lit(""))


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, EXTENSION, 1))


def registered_domain(surtkey: Column | str = "surtkey") -> Column:
    """``label.tld``; NULL when the key has fewer than two host labels."""
    return _registered(surt_host_parts(surtkey))


def full_subdomain(surtkey: Column | str = "surtkey") -> Column:
    """Labels below the registered domain in reading order, ``''`` if none."""
    return _below(surt_host_parts(surtkey))


def extension(surtkey: Column | str = "surtkey") -> Column:
    return _extension(surt_path(surtkey))


def filename(surtkey: Column | str = "surtkey") -> Column:
    return F.regexp_extract(surt_path(surtkey), FILENAME, 1)


def pdf_name(surtkey: Column | str = "surtkey") -> Column:
    return F.regexp_extract(surt_path(surtkey), PDF_NAME, 1)


def path_depth(surtkey: Column | str = "surtkey") -> Column:
    return F.size(_path_pieces(surt_path(surtkey)))


def surt_prefix(domain: Column | str) -> Column:
    """``doi.gov`` -> ``gov,doi`` on a column of domain names."""
    return F.array_join(F.reverse(F.split(_col(domain), r"\.")), ",")


def surt_prefix_of(domain: str) -> str:
    """The same for one plain Python string."""
    return ",".join(reversed(domain.split(".")))


def label_if_empty(c: Column | str, label: str) -> Column:
    """Replace NULL and ``''`` by a visible label."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(label))


# --- whole frames -----------------------------------------------------------

URL_COLUMNS = ["host", "url_path", "url_query"] + [
    f"path_seg_{i}" for i in range(1, PATH_DEPTH + 1)
]
SURT_COLUMNS = (
    ["surthost"]
    + [f"surthost_seg_{i}" for i in range(SURT_HOST_DEPTH)]
    + [f"surtpath_{i}" for i in range(1, SURT_PATH_DEPTH + 1)]
)
# Stored next to the SURT columns so that reports read a narrow column
# instead of running a pattern over every key again.
DERIVED_COLUMNS = ["reg_domain", "sub_full", "ext", "filename", "pdf_name", "depth"]


# Host, path and their pieces are computed in steps, each once per row: Catalyst
# does not merge a projection into the next one when that would repeat work.


def with_url_columns(df: DataFrame, url: str = "url") -> DataFrame:
    base = df.withColumns({"host": host(url), "url_path": url_path(url), "url_query": url_query(url)})
    pieces = base.withColumn("_path", _path_pieces(F.col("url_path")))
    return pieces.withColumns(
        {f"path_seg_{i}": F.get("_path", F.lit(i - 1)) for i in range(1, PATH_DEPTH + 1)}
    ).drop("_path")


def _with_pieces(df: DataFrame, surtkey: str) -> DataFrame:
    base = df.withColumns({"surthost": surt_host(surtkey), "_path": surt_path(surtkey)})
    return base.withColumns(
        {"_labels": _pieces(F.col("surthost"), ","), "_segments": _path_pieces(F.col("_path"))}
    )


def _segment_columns() -> dict[str, Column]:
    cols = {f"surthost_seg_{i}": F.get("_labels", F.lit(i)) for i in range(SURT_HOST_DEPTH)}
    for i in range(1, SURT_PATH_DEPTH + 1):
        cols[f"surtpath_{i}"] = F.get("_segments", F.lit(i - 1))
    return cols


def _derived_columns() -> dict[str, Column]:
    labels, path = F.col("_labels"), F.col("_path")
    return {
        "reg_domain": _registered(labels),
        "sub_full": _below(labels),
        "ext": _extension(path),
        "filename": F.regexp_extract(path, FILENAME, 1),
        "pdf_name": F.regexp_extract(path, PDF_NAME, 1),
        "depth": F.size("_segments"),
    }


_TEMPORARY = ("_path", "_labels", "_segments")


def with_surt_columns(df: DataFrame, surtkey: str = "surtkey") -> DataFrame:
    return _with_pieces(df, surtkey).withColumns(_segment_columns()).drop(*_TEMPORARY)


def with_derived_columns(df: DataFrame, surtkey: str = "surtkey") -> DataFrame:
    """Add the derived columns; ``surthost`` comes along."""
    return _with_pieces(df, surtkey).withColumns(_derived_columns()).drop(*_TEMPORARY)


def with_all_surt_columns(df: DataFrame, surtkey: str = "surtkey") -> DataFrame:
    """SURT and derived columns together, from one pass over the key."""
    both = {**_segment_columns(), **_derived_columns()}
    return _with_pieces(df, surtkey).withColumns(both).drop(*_TEMPORARY)


def stored_or(df: DataFrame, name: str, otherwise: Column) -> Column:
    """The stored column when the frame has it, else the expression."""
    return F.col(name) if name in df.columns else otherwise

"""Domain dimension, domain labels and domain filters.

A label needs no join: the SURT prefix (or the host suffix) of the row *is*
the domain, so membership is an ``IN`` set test that stays in codegen however
long the list is. A dimension table of unknown size is joined instead, and
Catalyst picks the join from its real size; no broadcast hint is given.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surtscope.config import TARGET_DOMAINS
from surtscope.functions import urls


def folder_names(domains=TARGET_DOMAINS, drop_suffix: str = ".gov") -> dict[str, str]:
    """``NN_base`` per domain, numbered alphabetically."""
    return {
        d: f"{i:02d}_{d.removesuffix(drop_suffix)}" for i, d in enumerate(sorted(domains), 1)
    }


def domain_dimension(
    spark: SparkSession, domains=TARGET_DOMAINS, drop_suffix: str = ".gov"
) -> DataFrame:
    """``domain, surt_prefix, folder``. A local relation, so its size is known exactly."""
    folders = folder_names(domains, drop_suffix)
    rows = pa.table(
        {
            "domain": list(domains),
            "surt_prefix": [urls.surt_prefix_of(d) for d in domains],
            "folder": [folders[d] for d in domains],
        }
    )
    return spark.createDataFrame(rows)


def _by_label_count(domains) -> dict[int, list[str]]:
    groups: dict[int, list[str]] = {}
    for d in domains:
        groups.setdefault(d.count(".") + 1, []).append(d)
    return groups


def _first_listed(candidates: list[Column], domains) -> Column:
    """Of several matching labels take the one listed first."""
    if len(candidates) == 1:
        return candidates[0]
    listed = F.array(*[F.lit(d) for d in domains])
    ranked = [F.when(c.isNotNull(), F.array_position(listed, c)) for c in candidates]
    best = F.least(*ranked)
    return F.when(best.isNotNull(), F.get(listed, (best - 1).cast("int")))


def _surt_prefix(key: Column, labels: int) -> Column:
    """The first ``labels`` host labels of a SURT key, ``''`` if it has fewer."""
    return F.regexp_extract(key, r"^([^,):]+(?:,[^,):]+){%d})[,):]" % (labels - 1), 1)


def surt_domain(surtkey: Column | str, domains=TARGET_DOMAINS) -> Column:
    """Target domain of a SURT key, else NULL.

    Three key shapes belong to ``gov,doi``: ``gov,doi)…``, ``gov,doi:8080)…``
    and ``gov,doi,sub…``.
    """
    key = F.col(surtkey) if isinstance(surtkey, str) else surtkey
    candidates = []
    for labels, members in _by_label_count(domains).items():
        prefix = _surt_prefix(key, labels)
        prefixes = [urls.surt_prefix_of(d) for d in members]
        name = F.array_join(F.reverse(F.split(prefix, ",")), ".")
        candidates.append(F.when(prefix.isin(*prefixes), name))
    return _first_listed(candidates, domains)


def host_domain(host: Column | str, domains=TARGET_DOMAINS) -> Column:
    """Target domain a host equals or is a subdomain of, else NULL."""
    h = F.col(host) if isinstance(host, str) else host
    candidates = []
    for labels, members in _by_label_count(domains).items():
        suffix = F.substring_index(h, ".", -labels)
        candidates.append(F.when(suffix.isin(*members), suffix))
    return _first_listed(candidates, domains)


def registered_or_other(df: DataFrame, domains=TARGET_DOMAINS, surtkey: str = "surtkey") -> Column:
    """Registered domain when it is a target, else ``other`` (a port makes it ``other``)."""
    reg = urls.stored_or(df, "reg_domain", urls.registered_domain(surtkey))
    return F.coalesce(F.when(reg.isin(*domains), reg), F.lit("other"))


LABEL = "base_domain"


def target(df: DataFrame, domains=TARGET_DOMAINS, surtkey: str = "surtkey") -> Column:
    """Target domain of a row, else NULL.

    A table that was loaded with domain labels is partitioned by them, so the
    stored label costs nothing and lets Spark skip folders of other domains.
    The labels must come from a list that holds at least ``domains``.
    """
    if LABEL in df.columns:
        return F.when(F.col(LABEL).isin(*domains), F.col(LABEL))
    return surt_domain(surtkey, domains)


def of_one_domain(df: DataFrame, domain: str, surtkey: str = "surtkey") -> DataFrame:
    """Rows of one domain: by folder if labels are stored, by key prefix otherwise."""
    if LABEL in df.columns:
        return df.where(F.col(LABEL) == domain)
    return df.where(is_one_domain(surtkey, domain))


def is_one_domain(surtkey: Column | str, domain: str) -> Column:
    """Filter for one domain as three prefix tests, which reach the Parquet scan."""
    key = F.col(surtkey) if isinstance(surtkey, str) else surtkey
    p = urls.surt_prefix_of(domain)
    return key.startswith(p + ")") | key.startswith(p + ":") | key.startswith(p + ",")


def only_targets(df: DataFrame, domains=TARGET_DOMAINS, surtkey: str = "surtkey") -> DataFrame:
    """Rows of target domains: by folder if labels are stored."""
    if LABEL in df.columns:
        return df.where(F.col(LABEL).isin(*domains))
    return df.where(target(df, domains, surtkey).isNotNull())


def outside_targets(df: DataFrame, domains=TARGET_DOMAINS, surtkey: str = "surtkey") -> DataFrame:
    """Rows of no target domain, by folder if labels are stored. A row without a key is in
    neither set."""
    with_key = df.where(F.col(surtkey).isNotNull())
    if LABEL in df.columns:
        return with_key.where(~F.coalesce(F.col(LABEL).isin(*domains), F.lit(False)))
    return with_key.where(target(df, domains, surtkey).isNull())


def is_host_in(host: Column | str, domain: str) -> Column:
    h = F.col(host) if isinstance(host, str) else host
    return (h == domain) | h.endswith("." + domain)


def label_from_dimension(
    df: DataFrame, dimension: DataFrame, surtkey: str = "surtkey", how: str = "inner"
) -> DataFrame:
    """Label rows from a dimension table of domains of any depth, any number of them.

    Adds ``domain`` and the other dimension columns. Of nested domains the deepest that
    holds the row counts. ``how="inner"`` drops rows of no listed domain, ``"left"`` keeps
    them with NULLs. A domain that is listed twice is an error of the dimension and raises.

    The dimension says which numbers of labels occur (one row, read first). Each key is
    tried with its prefixes of these lengths only, longest first: the lengths are joined
    in turn, each join taking what the longer ones left, so no key is copied and no row
    is lost.
    """
    columns = [c for c in dimension.columns if c != "surt_prefix"]
    known = dimension.withColumn("_labels", F.size(F.split("surt_prefix", ",")))
    found = known.agg(
        F.sort_array(F.collect_set("_labels"), asc=False).alias("depths"),
        (F.count("surt_prefix") - F.count_distinct("surt_prefix")).alias("twice"),
    ).first()
    if found.twice:
        raise ValueError("a domain is listed twice in the dimension")
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how!r}")
    rest = df
    for depth in found.depths:
        level = known.where(F.col("_labels") == depth).select(
            F.col("surt_prefix").alias("_prefix"), F.struct(*columns).alias(f"_hit{depth}")
        )
        rest = rest.withColumn("_prefix", _surt_prefix(F.col(f"`{surtkey}`"), depth)).join(level, "_prefix", "left").drop("_prefix")
    hit = F.coalesce(*[F.col(f"_hit{d}") for d in found.depths]) if found.depths else None
    if hit is None:
        empty = [F.lit(None).cast(dimension.schema[c].dataType).alias(c) for c in columns]
        none = df.select("*", *empty)
        return none if how == "left" else none.limit(0)
    labelled = rest.withColumn("_hit", hit)
    if how == "inner":
        labelled = labelled.where(F.col("_hit").isNotNull())
    return labelled.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_hit.`{c}`").alias(c) for c in columns])

"""Captures derived from the ``events`` and ``pages`` tables.

Each event becomes one capture of one page. Every event and every page takes
part. Pages are captured in one to six crawl years, later years more often;
some captures are DNS records, documents, redirects or errors, and some hosts
carry a port. The 13 raw columns are those of a capture line, so the frame can
be written as CDXJ text or loaded like one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtscope.functions import urls
from surtscope.sources import cdxj

_EVENTS_PER_SHARD = 50_000


def raw_captures(events: DataFrame, pages: DataFrame) -> DataFrame:
    """The raw capture columns plus ``event_id, crawl_year, shard``.

    ``html`` is reduced to its digest and length before the join, so only
    narrow rows are shuffled.
    """
    page_count = pages.agg(F.count(F.lit(1))).scalar()
    page = pages.select(
        "page_id",
        "url",
        F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0).alias("origin"),
        urls.host("url").alias("host"),
        F.md5("html").alias("page_digest"),
        F.length("html").cast("bigint").alias("page_length"),
        F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1).alias("lang"),
    )
    event = events.select(
        "event_id",
        "user_id",
        "event_type",
        "ts",
        (F.col("event_id") % page_count).alias("page_id"),
    )
    kind, user = F.col("event_type"), F.col("user_id")
    is_dns = (kind == "error") & (user % 5 == 0)
    has_port = (kind == "view") & (user % 10 == 3)
    year = F.lit(2004) + 4 * (5 - user % (1 + F.col("page_id") % 6))

    joined = event.join(page, "page_id").withColumns(
        {"is_dns": is_dns, "has_port": has_port, "crawl_year": year.cast("string")}
    )
    origin = F.col("origin")
    url = (
        F.when(is_dns, F.concat(F.lit("dns:"), "host"))
        .when(
            kind == "purchase",
            F.concat(
                origin,
                F.lit("/docs/"),
                "crawl_year",
                F.lit("/reports/q"),
                (user % 4).cast("string"),
                F.lit("/report_"),
                (F.col("event_id") % 50).cast("string"),
                F.lit(".pdf"),
            ),
        )
        .when(kind == "signup", F.concat(origin, F.lit("/node/"), F.col("page_id").cast("string")))
        .when(kind == "error", F.concat(origin, F.lit("/Missing/"), user.cast("string")))
        .when(
            has_port,
            F.concat(origin, F.lit(":8080"), F.substr("url", F.length(origin) + 1)),
        )
        .otherwise(F.col("url"))
    )
    joined = joined.withColumn("url", url)
    path, query = urls.url_path("url"), F.lower(F.regexp_extract("url", r"[?]([^#]*)", 1))
    surt_host = F.concat(
        F.array_join(
            F.reverse(F.split(F.regexp_replace("host", r"^www[0-9]*[.]", ""), r"\.")), ","
        ),
        F.when(F.col("has_port"), ":8080").otherwise(""),
    )
    surt_path = F.when(F.col("is_dns") | path.isin("", "/"), "/").otherwise(
        F.regexp_replace(F.lower(path), r"/\z", "")
    )
    surt_query = F.when(~F.col("is_dns") & (query != ""), F.concat(F.lit("?"), query)).otherwise("")
    mime = (
        F.when(F.col("is_dns"), "text/dns")
        .when(kind == "purchase", "application/pdf")
        .when(kind != "view", "text/html")
    )
    detected = (
        F.when(~F.col("is_dns") & (kind == "purchase"), "application/pdf")
        .when((kind == "click") & (user % 4 == 0), "application/xhtml+xml")
        .when(~F.col("is_dns"), "text/html")
    )
    status = (
        F.when(F.col("is_dns"), F.lit(None))
        .when((kind == "error") & (user % 2 == 0), 503)
        .when(kind == "error", 404)
        .when(kind == "signup", 301)
        .otherwise(200)
    )
    length = (
        F.when(F.col("is_dns"), F.length("host") + 60)
        .when(kind == "signup", 0)
        .otherwise(F.col("page_length") + user % 7)
    )
    return joined.select(
        "url",
        mime.alias("mime"),
        status.cast("string").alias("status"),
        F.when(kind != "signup", F.col("page_digest")).alias("digest"),
        length.cast("string").alias("length"),
        (F.col("event_id") * 1000).cast("string").alias("offset"),
        F.concat(
            F.lit("crawl-"), "crawl_year", F.lit("-"), (user % 20).cast("string"), F.lit(".warc.gz")
        ).alias("filename"),
        detected.alias("mime-detected"),
        F.when(kind == "purchase", "fmt/276").alias("puid"),
        F.when(mime == "text/html", "UTF-8").alias("charset"),
        F.nullif(F.col("lang"), F.lit("")).alias("languages"),
        F.concat(surt_host, F.lit(")"), surt_path, surt_query).alias("surtkey"),
        F.concat(
            "crawl_year",
            F.when(user % 2 == 0, "01").otherwise("03"),
            F.date_format("ts", "ddHH"),
            F.lit("0000"),
        ).alias("timestamp"),
        "event_id",
        "crawl_year",
        F.floor(F.col("event_id") / _EVENTS_PER_SHARD).cast("bigint").alias("shard"),
    )


def _capture_line() -> Column:
    fields = F.to_json(F.struct(*[F.col(f"`{k}`") for k in cdxj.JSON_KEYS]))
    return F.concat_ws(" ", "surtkey", "timestamp", fields)


def _broken_line() -> Column:
    """A malformed line of one of six kinds."""
    head = F.concat_ws(" ", "surtkey", "timestamp")
    small = F.concat(F.lit('{"url":"'), "url", F.lit('"'))
    kind = F.col("event_id") % 6
    return (
        F.when(kind == 0, F.col("surtkey"))
        .when(kind == 1, F.concat_ws(" ", head, F.concat(small, F.lit(","))))
        .when(kind == 2, F.concat_ws(" ", head, F.concat(small, F.lit("} trailing"))))
        .when(kind == 3, F.concat_ws(" ", head, F.lit("[1]")))
        .when(kind == 4, F.concat_ws(" ", head, F.concat(small, F.lit(',"status":"-"}'))))
        .otherwise(F.lit(""))
    )


def archive_lines(raw: DataFrame) -> DataFrame:
    """CDXJ lines of raw captures, a malformed line after each redirect, in one pass:
    ``crawl_year, shard, event_id, part, value``."""
    line = F.struct(F.lit(0).alias("part"), _capture_line().alias("value"))
    broken = F.struct(F.lit(1).alias("part"), _broken_line().alias("value"))
    both = F.array_compact(F.array(line, F.when(F.col("status") == "301", broken)))
    return raw.select("crawl_year", "shard", "event_id", F.inline(both))


def index_rows(captures: DataFrame) -> DataFrame:
    """A Parquet-index view of captures: no DNS records and no 2024 crawl."""
    labels = F.split("host", r"\.")
    return captures.where(
        (F.col("crawl_year") != "2024") & ~F.col("mime").eqNullSafe("text/dns")
    ).select(
        "url",
        F.col("surtkey").alias("url_surtkey"),
        F.col("host").alias("url_host_name"),
        F.substring_index("host", ".", -2).alias("url_host_registered_domain"),
        F.try_element_at(labels, F.lit(-2)).alias("url_host_2nd_last_part"),
        F.try_element_at(labels, F.lit(-1)).alias("url_host_private_suffix"),
        F.col("status").alias("fetch_status"),
        F.col("digest").alias("content_digest"),
        F.when(F.col("status") == 200, "warc").otherwise("cdx").alias("subset"),
        "crawl_year",
    )

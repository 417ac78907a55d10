"""Named queries over the given tables.

The captures, the index and the capture files are derived from ``events`` and
``pages`` by Spark and written once per session to the shared folder, as a real
archive would be loaded once and queried often. Every query reads those tables
whole.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surtscope import session
from surtscope.config import CRAWL_YEARS
from surtscope.functions import urls
from surtscope.operators import domains as dom
from surtscope.operators import rollups as roll
from surtscope.plans import content, dedup, dns, hosts, overview, reconcile, structure
from surtscope.sources import cdxj, derived, index, inventory
from surtscope.streaming import ingest
from surtscope.tables import index_table, report_table, store

DOMAINS = ("example.com", "example.net")
ONE_DOMAIN = "example.com"
SUFFIX = ".com"
#: Domains of one to three labels, some within others.
NESTED_DOMAINS = ("com", "example.com", "cheap-pills.example.com", "net", "example.org", "thther.example.org")
YEARS = CRAWL_YEARS

_WRITTEN: dict[tuple[str, str, str], str] = {}


class Archive:
    """The derived tables of one input folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _once(self, label: str, make: Callable[[str], None]) -> str:
        key = (self.spark.sparkContext.applicationId, self.folder, label)
        if key not in _WRITTEN:
            path = session.run_folder(self.spark, label)
            make(path)
            _WRITTEN[key] = path
        return _WRITTEN[key]

    def raw(self) -> DataFrame:
        return derived.raw_captures(self.given("events"), self.given("pages"))

    def captures_path(self) -> str:
        def make(path: str) -> None:
            typed = cdxj.typed_records(self.raw(), F.col("crawl_year"))
            store.write_captures(typed, path, DOMAINS)

        return self._once("captures", make)

    def captures(self) -> DataFrame:
        return store.read(self.spark, self.captures_path())

    def index_path(self) -> str:
        def make(path: str) -> None:
            rows = derived.index_rows(self.captures())
            keyed = rows.withColumn("crawl", F.concat(F.lit("CRAWL-"), "crawl_year")).drop("crawl_year")
            store.write(keyed, path, partitions=["crawl"], sort=["url_surtkey"])

        return self._once("index", make)

    def index_folders(self) -> dict[str, str]:
        return {y: f"{self.index_path()}/crawl=CRAWL-{y}" for y in YEARS if y != "2024"}

    def index_table_path(self) -> str:
        """The index files loaded into a table with stored domain labels."""

        def make(path: str) -> None:
            index_table.load_years(self.spark, self.index_folders(), path, list(self.index_folders()), DOMAINS)

        return self._once("index-table", make)

    def index(self) -> DataFrame:
        return index_table.read(self.spark, self.index_table_path())

    def lines_path(self) -> str:
        """Gzip capture files, one per crawl year and shard, with broken lines in between."""

        def make(path: str) -> None:
            named = derived.archive_lines(self.raw()).withColumn("crawl", F.concat(F.lit("CRAWL-"), "crawl_year"))
            placed = named.repartition("crawl", "shard").sortWithinPartitions(
                "crawl", "shard", "event_id", "part"
            )
            placed.select("crawl", "shard", "value").write.partitionBy("crawl", "shard").option("compression", "gzip").text(path)

        return self._once("lines", make)

    def lines(self) -> DataFrame:
        return cdxj.read_lines(self.spark, self.lines_path(), "*.gz", recursive=True)

    def size_histogram(self) -> DataFrame:
        def make(path: str) -> None:
            store.write(content.size_histogram(self.captures()), path, sort=["length"])

        path = self._once("size-histogram", make)
        return self.spark.read.schema(content.size_histogram(self.captures()).schema).parquet(path)

    def report_base(self) -> DataFrame:
        def make(path: str) -> None:
            base = structure.report_base(self.captures(), ["base_domain"])
            store.write(base, path, partitions=["base_domain"], sort=["surtpath_1"])

        path = self._once("report-base", make)
        return self.spark.read.parquet(path)


Query = Callable[[SparkSession, str], DataFrame]


def _on_captures(report: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: report(Archive(spark, folder).captures(), *args, **kwargs)


def _on_index(report: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, folder: report(Archive(spark, folder).index(), *args, **kwargs)


def _on_both(report: Callable[..., DataFrame], *args, **kwargs) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        a = Archive(spark, folder)
        return report(a.captures(), a.index(), *args, **kwargs)

    return run


def _on_all(report: Callable[..., DataFrame], *args, **kwargs) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        a = Archive(spark, folder)
        return report(spark, a.captures(), a.index(), *args, **kwargs)

    return run


def _path_heat(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_logs(structure.path_heat(Archive(spark, folder).captures()))


def _rounded_logs(heat: DataFrame) -> DataFrame:
    return heat.withColumns({f"log_{y}": F.round(f"log_{y}", 9) for y in YEARS})


def _overlap_pct(spark: SparkSession, folder: str) -> DataFrame:
    captures = Archive(spark, folder).captures()
    return dedup.year_overlap_pct(dedup.year_overlap(captures, DOMAINS))


def _reports() -> dict[str, Query]:
    """Q01-Q74, one entry per named report."""
    c, p, b = _on_captures, _on_index, _on_both
    queries: dict[str, Query] = {
        "q01_overview": c(overview.overview),
        "q02_captures_per_host": c(overview.captures_per_host),
        "q03_captures_per_year": c(overview.captures_per_year),
        "q04_index_rows_per_year": p(overview.index_rows_per_year),
        "q05_host_year_counts": c(overview.host_year_counts),
        "q06_surtkey_year_counts": c(overview.surtkey_year_counts),
        "q07_surt_sample": c(overview.surt_sample),
        "q08_domain_summary": c(overview.domain_summary),
        "q08_domain_summary_full": c(overview.domain_summary, level="full"),
        "q09_subdomain_breakdown": c(overview.subdomain_breakdown, limit=30),
        "q09_subdomain_breakdown_full": c(overview.subdomain_breakdown, level="full"),
        "q10_unique_subdomains": c(overview.unique_subdomains),
        "q11_domain_ranking": c(overview.domain_ranking, DOMAINS),
        "q12_top_subdomains": c(overview.top_subdomains, DOMAINS),
        "q13_domain_year_table": c(overview.domain_year_table, DOMAINS),
        "q14_status_distribution": c(content.status_distribution),
        "q15_status_classes": c(content.status_classes_by_domain, DOMAINS),
        "q16_mime_distribution": c(content.mime_distribution),
        "q17_mime_mismatch": c(content.mime_mismatch),
        "q18_size_statistics": lambda s, f: content.size_statistics(Archive(s, f).size_histogram(), DOMAINS),
        "q19_digest_duplication": c(content.digest_duplication, DOMAINS),
        "q20_digest_duplication_overall": c(content.digest_duplication_overall),
        "q21_captures_per_month": c(overview.captures_per_month),
        "q22_total_diff": b(reconcile.total_diff),
        "q23_year_diff": b(reconcile.year_diff),
        "q23_year_diff_filled": b(reconcile.year_diff, missing_as_zero=True),
        "q24_year_domain_diff": b(reconcile.year_domain_diff, DOMAINS),
        "q25_year_summary": lambda s, f: reconcile.year_summary(
            b(reconcile.year_domain_diff, DOMAINS)(s, f)
        ),
        "q26_domain_diff": b(reconcile.domain_diff, DOMAINS),
        "q27_domain_year_gaps": b(reconcile.domain_year_gaps, DOMAINS),
        "q28_subset_breakdown": p(reconcile.subset_breakdown, DOMAINS),
        "q29_duplicate_rows": b(reconcile.duplicate_rows, DOMAINS),
        "q30_outside_targets": p(reconcile.outside_targets, DOMAINS),
        "q31_domain_year_matrix": _on_all(
            reconcile.domain_year_matrix, DOMAINS, YEARS, drop_suffix=SUFFIX
        ),
        "q31_domain_year_long": _on_all(reconcile.domain_year_long, DOMAINS, YEARS),
        "q32_split_report": _on_all(reconcile.split_report, DOMAINS, drop_suffix=SUFFIX),
        "q38_paths_seen_in": c(structure.paths_seen_in, ["2004", "2008"]),
        "q38_paths_seen_in_one_year": c(structure.paths_seen_in, ["2016"]),
        "q39_extensions": c(structure.extensions),
        "q40_filenames": c(structure.filenames),
        "q41_top_subdomains_by_year": c(structure.top_subdomains_by_year),
        "q42_path_heat": _path_heat,
        "q43_path_churn": c(structure.path_churn),
        "q44_path_churn_all_periods": c(structure.path_churn_all_periods),
        "q45_extension_totals": c(structure.extension_totals),
        "q45_extension_totals_top2": c(structure.extension_totals, 2),
        "q46_extension_shift": c(structure.extension_shift),
        "q47_top_paths": c(structure.top_paths),
        "q47_top_paths_per_year": c(structure.top_paths_per_year),
        "q48_pdf_per_year": c(structure.pdf_per_year),
        "q49_path_depth": c(structure.path_depth),
        "q50_clean_urls": c(structure.clean_urls),
        "q51_pdf_names": c(structure.pdf_names),
        "q51_unique_pdf_names": c(structure.unique_pdf_names),
        "q52_node_ids": c(structure.node_ids),
        "q53_mime_by_extension": c(structure.mime_by_extension),
        "q54_duplication": c(dedup.duplication, DOMAINS),
        "q54_total_true_duplicates": lambda s, f: dedup.total_true_duplicates(
            c(dedup.duplication, DOMAINS)(s, f)
        ),
        "q55_redundancy_heat": lambda s, f: dedup.redundancy_heat(
            c(dedup.duplication, DOMAINS)(s, f)
        ),
        "q56_unique_heat": lambda s, f: dedup.unique_heat(c(dedup.duplication, DOMAINS)(s, f)),
        "q57_most_captured": c(dedup.most_captured, DOMAINS),
        "q57_most_captured_overall": c(dedup.most_captured_overall, DOMAINS),
        "q58_year_overlap": c(dedup.year_overlap, DOMAINS),
        "q58_year_overlap_pct": _overlap_pct,
        "q59_dns_share": c(dns.dns_share, DOMAINS),
        "q60_dns_sample": c(dns.dns_sample, ONE_DOMAIN),
        "q61_dns_totals": c(dns.dns_totals, ONE_DOMAIN),
        "q62_dns_top_hosts": c(dns.dns_top_hosts, ONE_DOMAIN),
        "q63_dns_repeats": c(dns.dns_repeats, ONE_DOMAIN),
        "q64_index_second_label": p(hosts.index_counts, "url_host_2nd_last_part"),
        "q65_index_private_suffix": p(hosts.index_counts, "url_host_private_suffix"),
        "q66_index_not_found": p(hosts.index_with_status, 404),
        "q67_domain_hosts": c(hosts.domain_hosts, DOMAINS),
        "q68_host_first_paths": c(hosts.host_first_paths, ONE_DOMAIN),
        "q69_domain_host_paths": c(hosts.domain_host_paths, DOMAINS, 1),
        "q70_domain_host_two_paths": c(hosts.domain_host_paths, DOMAINS, 2),
        "q71_url_contains": c(hosts.url_contains, ONE_DOMAIN),
        "q72_parse_errors": _parse_errors,
        "q72_error_types": lambda s, f: cdxj.error_type_counts(
            cdxj.errors(Archive(s, f).lines())
        ),
        "q73_distinct_values": _distinct_values,
        "q74_pending_files": _pending_files,
    }
    for depth in range(1, 6):
        queries[f"q{32 + depth}_path_prefixes_{depth}"] = c(structure.path_prefixes, depth)
    queries["q34_path_prefixes_2_root"] = c(structure.path_prefixes, 2, root_label="(root)")
    return queries


def _parse_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Quarantine with the run-dependent file name cut to its year and shard."""
    bad = cdxj.errors(Archive(spark, folder).lines())
    place = F.regexp_extract("file", r"(crawl=[^/]+/shard=[^/]+)/", 1)
    return bad.withColumn("file", place)


def _distinct_values(spark: SparkSession, folder: str) -> DataFrame:
    captures = Archive(spark, folder).captures()
    return overview.distinct_values(captures, cdxj.CAPTURE_COLUMNS)


def _remote_files(a: Archive) -> DataFrame:
    """An inventory with one entry per page: its URL path as key, its size."""
    return a.given("pages").select(
        F.concat(F.lit("crawl-data/"), F.md5("url"), F.lit(".cdxj.gz")).alias("key"),
        F.when(F.col("page_id") % 2 == 0, F.length("html").cast("bigint")).alias("size"),
    )


def _local_files(a: Archive) -> DataFrame:
    """Fetched files: pages of www hosts or with a query, the latter one byte short."""
    return (
        a.given("pages")
        .where(F.contains(F.col("url"), F.lit("www.")) | F.contains(F.col("url"), F.lit("?")))
        .select(
            F.concat(F.md5("url"), F.lit(".cdxj.gz")).alias("name"),
            (
                F.length("html") - F.when(F.contains(F.col("url"), F.lit("?")), 1).otherwise(0)
            ).cast("bigint").alias("size"),
        )
    )


def _pending_files(spark: SparkSession, folder: str) -> DataFrame:
    a = Archive(spark, folder)
    return inventory.pending_summary(_remote_files(a), _local_files(a))


def _sources() -> dict[str, Query]:
    """Scans (SRC*) and column functions (PRJ*, FLT*)."""

    def loaded(s, f):
        lines = Archive(s, f).lines()
        year = cdxj.year_from_path()
        return cdxj.captures(cdxj.records(lines), year, DOMAINS)

    def converted(s, f):
        a = Archive(s, f)
        path = session.run_folder(s, "converted")
        store.convert_cdxj(a.lines(), path)
        return s.read.parquet(path).withColumnRenamed("mime-detected", "mime_detected")

    def file_years(s, f):
        rows = index.read_recursive(s, Archive(s, f).index_path())
        return index.with_year_from_file(rows).groupBy("crawl_year").agg(
            F.count(F.lit(1)).alias("rows")
        )

    def named_years(s, f):
        rows = index.read_years(s, Archive(s, f).index_folders(), ["2004", "2020"])
        return rows.groupBy("crawl_year", "subset").agg(F.count(F.lit(1)).alias("rows"))

    def pruned_year(s, f):
        rows = index.read_partitioned(s, Archive(s, f).index_path(), "crawl")
        return rows.where(F.col("crawl") == "CRAWL-2020").groupBy("fetch_status").agg(
            F.count(F.lit(1)).alias("rows")
        )

    def file_total(s, f):
        files = index.list_files(s, Archive(s, f).index_path())
        year = cdxj.year_from_path("key")
        return files.groupBy(year.alias("crawl_year")).agg(
            (F.count(F.lit(1)) > 0).alias("has_files"), (F.sum("size") > 0).alias("has_bytes")
        )

    def manifest(s, f):
        a = Archive(s, f)
        path = session.run_folder(s, "manifest")
        _remote_files(a).select(F.concat(F.lit(" "), "key").alias("value")).write.option(
            "compression", "gzip"
        ).text(path)
        return inventory.with_suffix(inventory.read_manifest(s, path), ".cdxj.gz")

    def pending(s, f):
        a = Archive(s, f)
        return inventory.pending(_remote_files(a), _local_files(a)).select("key", "size")

    def event_id():
        return (F.col("offset") / 1000).cast("bigint").alias("event_id")

    def url_parts(s, f):
        rows = Archive(s, f).captures().select(event_id(), "url")
        return urls.with_url_columns(rows).withColumns(
            {
                "authority_host": urls.authority_host("url"),
                "host_and_port": urls.host_and_port("url"),
                "path1": urls.first_segment("url_path"),
                "path2": urls.first_two_segments("url_path"),
            }
        )

    def surt_parts(s, f):
        rows = Archive(s, f).captures().select(event_id(), "surtkey")
        return urls.with_all_surt_columns(rows).withColumns(
            {
                "tld": urls.tld(),
                "by_surt": dom.surt_domain("surtkey", DOMAINS),
                "by_prefix": F.when(dom.is_one_domain("surtkey", ONE_DOMAIN), ONE_DOMAIN),
                "path_number": F.col("surtpath_2").try_cast("int"),
            }
        )

    def by_dimension(s, f):
        a = Archive(s, f)
        rows = dom.label_from_dimension(
            a.captures(), dom.domain_dimension(s, DOMAINS, SUFFIX)
        )
        return rows.groupBy("domain", "folder").agg(F.count(F.lit(1)).alias("n"))

    def by_nested_dimension(s, f):
        """Labels of one to three levels, nested ones included; no capture is lost."""
        rows = dom.label_from_dimension(
            Archive(s, f).captures(), dom.domain_dimension(s, NESTED_DOMAINS, SUFFIX), how="left"
        )
        return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))

    return {
        "src_index_file_count": lambda s, f: index.file_count(s, Archive(s, f).lines_path(), "*.gz"),
        "prj_label_any_depth": by_nested_dimension,
        "src_cdxj_load": loaded,
        "src_cdxj_convert": converted,
        "src_dns_lines": lambda s, f: cdxj.captures(
            cdxj.dns_records(Archive(s, f).lines()), cdxj.year_from_path(), DOMAINS
        ).select("url", "host", "surtkey", "fetch_timestamp", "crawl_year", "length"),
        "src_index_year_from_file": file_years,
        "src_index_named_years": named_years,
        "src_index_partition_key": pruned_year,
        "src_index_file_listing": file_total,
        "src_manifest": manifest,
        "src_pending": pending,
        "prj_url_parts": url_parts,
        "prj_surt_parts": surt_parts,
        "prj_label_from_dimension": by_dimension,
        "flt_outside_targets": lambda s, f: dom.outside_targets(
            Archive(s, f).captures(), DOMAINS
        ).groupBy("surthost").agg(F.count(F.lit(1)).alias("n")),
        "agg_status_share_by_year": lambda s, f: _share_by_year(Archive(s, f).captures()),
    }


def _share_by_year(captures: DataFrame) -> DataFrame:
    """Share of the grand total held by each (year, status)."""
    return roll.with_share(roll.count_by(captures, ["crawl_year", "status"]), "n", "pct", 3)


def _tables() -> dict[str, Query]:
    """Table maintenance (SNK*) and streaming loads (STR*)."""
    key_counts = lambda df: df.groupBy("crawl_year", "base_domain").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("surtkey").alias("keys")
    )

    def without_dns(a: Archive) -> DataFrame:
        return a.captures().where(~F.col("mime").eqNullSafe("text/dns"))

    def load_table(s, f):
        a = Archive(s, f)
        path = session.run_folder(s, "loaded")
        store.load_years(
            s, a.lines_path(), path, ["2016", "2020"], DOMAINS, glob="*.gz", prefix="crawl=CRAWL-"
        )
        return key_counts(store.read(s, path))

    def load_replace(s, f):
        """Years loaded for all domains, then two of them again for one domain."""
        a = Archive(s, f)
        path = session.run_folder(s, "reloaded")
        args = {"glob": "*.gz", "prefix": "crawl=CRAWL-"}
        store.load_years(s, a.lines_path(), path, ["2012", "2016", "2020"], DOMAINS, **args)
        for _ in range(2):
            store.load_years(
                s, a.lines_path(), path, ["2016", "2020"], [ONE_DOMAIN], mode="replace", **args
            )
        return key_counts(store.read(s, path))

    def load_absent_year(s, f):
        """A year without a folder is skipped, the others are loaded whole."""
        a = Archive(s, f)
        path = session.run_folder(s, "absent-year")
        with warnings.catch_warnings(record=True):
            warnings.simplefilter("always")
            store.load_years(
                s, a.lines_path(), path, ["2020", "2025"], DOMAINS, [*YEARS, "2025"], "*.gz", "crawl=CRAWL-"
            )
        return key_counts(store.read(s, path))

    def load_quarantine(s, f):
        """Broken lines of a load by type, as its quarantine folder has them."""
        a = Archive(s, f)
        path = session.run_folder(s, "quarantined")
        store.load_years(s, a.lines_path(), path, "all", DOMAINS, glob="*.gz", prefix="crawl=CRAWL-")
        bad = s.read.option("header", "true").csv(f"{path}-errors")
        return cdxj.error_type_counts(bad)

    def backfill_interrupted(s, f):
        """A backfill that got through half of the domains is completed by the next."""
        a = Archive(s, f)
        path = session.run_folder(s, "half-backfilled")
        targets = F.col("base_domain") != "other"
        store.write(without_dns(a).where(targets), path)
        half = a.captures().where((F.col("mime") == "text/dns") & (F.col("base_domain") == ONE_DOMAIN))
        store.append(half, path)
        store.backfill_dns(s, a.lines(), path, cdxj.year_from_path(), DOMAINS)
        return key_counts(store.read(s, path))

    def stream_then_append(s, f):
        """A batch append to a table that a stream has written is read back."""
        a = Archive(s, f)
        path = session.run_folder(s, "streamed-appended")
        stream = ingest.capture_stream(s, a.lines_path(), "*.gz")
        ingest.load_new_files(stream, path, session.run_folder(s, "appended-mark"), DOMAINS)
        store.append(a.captures().where(F.col("base_domain") == "other"), path)
        return key_counts(store.read(s, path))

    def stream_quarantine(s, f):
        a = Archive(s, f)
        path = session.run_folder(s, "streamed-errors")
        stream = ingest.capture_stream(s, a.lines_path(), "*.gz")
        ingest.load_new_files(stream, path, session.run_folder(s, "errors-mark"), DOMAINS)
        bad = s.read.option("header", "true").csv(f"{path}-errors")
        return cdxj.error_type_counts(bad)

    def refreshed_base(s, f):
        """A report base kept up by deltas while years are loaded, replaced and appended."""
        a = Archive(s, f)
        path, base = session.run_folder(s, "followed"), session.run_folder(s, "followed-base")
        args = {"glob": "*.gz", "prefix": "crawl=CRAWL-"}
        steps = [
            lambda: store.load_years(s, a.lines_path(), path, ["2012", "2016"], DOMAINS, **args),
            lambda: store.load_years(s, a.lines_path(), path, ["2020"], DOMAINS, **args),
            lambda: store.load_years(s, a.lines_path(), path, ["2016"], [ONE_DOMAIN], mode="replace", **args),
            lambda: store.append(a.captures().where((F.col("crawl_year") == "2008") & (F.col("base_domain") != "other")), path),
        ]
        for step in steps:
            step()
            report_table.refresh(s, path, base)
        return report_table.read(s, base).groupBy("crawl_year", "base_domain").agg(
            F.count(F.lit(1)).alias("n"), F.sum("capture_count").alias("captures")
        )

    def refreshed_sizes(s, f):
        """Size statistics from a histogram that follows loaded and replaced years."""
        a = Archive(s, f)
        path, sizes = session.run_folder(s, "sized"), session.run_folder(s, "sizes")
        for years, domains, mode in ((["2016", "2020"], DOMAINS, "append"), (["2016"], [ONE_DOMAIN], "replace")):
            store.load_years(
                s, a.lines_path(), path, years, domains, glob="*.gz", prefix="crawl=CRAWL-", mode=mode
            )
            report_table.refresh(s, path, sizes, content.size_histogram)
        return content.size_statistics(report_table.read(s, sizes, content.size_histogram), DOMAINS)

    def propagate_all(s, f):
        """DNS records into the tables of all domains, twice; the second run adds nothing."""
        a = Archive(s, f)
        root = session.run_folder(s, "all-domains")
        full = a.captures().drop("base_domain")
        store.split_by_domain(without_dns(a).drop("base_domain"), root, DOMAINS)
        for _ in range(2):
            store.propagate_dns_all(full, root, DOMAINS)
        return s.read.parquet(root).groupBy("base_domain", "mime").agg(F.count(F.lit(1)).alias("n"))

    def propagate_counts(s, f):
        """The rows that a run over all domains adds to each, as it returns them."""
        a = Archive(s, f)
        root = session.run_folder(s, "all-counted")
        store.split_by_domain(without_dns(a).drop("base_domain"), root, DOMAINS)
        added = store.propagate_dns_all(a.captures().drop("base_domain"), root, DOMAINS)
        return s.createDataFrame(list(added.items()), "base_domain string, rows long")

    def split_ranges(s, f):
        """Domains split into files of key ranges; ``overlaps`` counts files that begin
        before the one before them ends."""
        path = session.run_folder(s, "split-ranges")
        rows = Archive(s, f).captures().drop("base_domain")
        store.split_by_domain(rows, path, DOMAINS, rows_per_file=200)
        files = (
            s.read.parquet(path)
            .groupBy("base_domain", F.input_file_name().alias("file"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("surtkey").alias("first"), F.max("surtkey").alias("last"))
        )
        before = F.lag("last").over(Window.partitionBy("base_domain").orderBy("first", "last"))
        return files.withColumn("before", before).groupBy("base_domain").agg(
            F.sum("n").alias("n"),
            (F.count(F.lit(1)) > 1).alias("several_files"),
            F.count_if(F.col("first") < F.col("before")).alias("overlaps"),
        )

    def load_interrupted(s, f):
        """A replacing load that dies before its switch leaves the old years whole."""
        a = Archive(s, f)
        path = session.run_folder(s, "interrupted")
        args = {"glob": "*.gz", "prefix": "crawl=CRAWL-"}
        store.load_years(s, a.lines_path(), path, ["2016", "2020"], DOMAINS, **args)
        half = store.read(s, path).where(F.col("base_domain") == ONE_DOMAIN)
        store.stage_load(half, path, "job-that-died")
        return key_counts(store.read(s, path))

    def load_counts(s, f):
        """The row counts that loads return, per run."""
        a = Archive(s, f)
        path = session.run_folder(s, "counted")
        args = {"glob": "*.gz", "prefix": "crawl=CRAWL-"}
        runs = [(["2016", "2020"], DOMAINS, "append"), (["2020"], [ONE_DOMAIN], "replace"), (["2004"], DOMAINS, "append")]
        found = [
            (i, store.load_years(s, a.lines_path(), path, years, domains, mode=mode, **args))
            for i, (years, domains, mode) in enumerate(runs)
        ]
        return s.createDataFrame(found, "run int, rows long")

    def load_quarantine_repeated(s, f):
        """Broken lines after three replacing loads: each of them once."""
        a = Archive(s, f)
        path = session.run_folder(s, "requarantined")
        for _ in range(3):
            store.load_years(
                s, a.lines_path(), path, "all", DOMAINS, glob="*.gz", prefix="crawl=CRAWL-", mode="replace"
            )
        bad = store.read_quarantine(s, path)
        return bad.groupBy("crawl_year", "error_type").agg(
            F.count(F.lit(1)).alias("n"), F.sum("line").alias("lines")
        )

    def load_index(s, f):
        """Two loads and a replacing one; the table keeps the label of every row."""
        a = Archive(s, f)
        path = session.run_folder(s, "index-loads")
        for years, mode in ((["2004", "2016"], "append"), (["2008", "2012", "2020"], "append"), (["2016"], "replace")):
            index_table.load_years(s, a.index_folders(), path, years, DOMAINS, mode=mode)
        rows = index_table.read(s, path)
        return rows.groupBy("crawl_year", "base_domain", "subset").agg(F.count(F.lit(1)).alias("n"))

    def load_index_counts(s, f):
        """The rows of each year as a load returns them."""
        a = Archive(s, f)
        years = list(a.index_folders())
        found = index_table.load_years(s, a.index_folders(), session.run_folder(s, "index-counted"), years, DOMAINS)
        return s.createDataFrame(list(found.items()), "crawl_year string, rows long")

    def load_index_evolved(s, f):
        """Crawls whose files differ in columns, their order and types end in one table."""
        a = Archive(s, f)
        path, folders = session.run_folder(s, "index-evolved"), {}
        of_year = {y: s.read.parquet(p) for y, p in a.index_folders().items() if y in ("2004", "2008", "2012")}
        variants = {
            "2004": of_year["2004"].drop("subset").withColumn("fetch_status", F.col("fetch_status").cast("smallint")),
            "2008": of_year["2008"].select(*reversed(of_year["2008"].columns)).withColumn("note", F.lower("subset")),
            "2012": of_year["2012"].withColumn("fetch_status", F.col("fetch_status").cast("bigint") * 10_000_000_000),
        }
        for year, df in variants.items():
            folders[year] = session.run_folder(s, f"index-variant-{year}")
            df.write.parquet(folders[year])
            index_table.load_years(s, folders, path, [year], DOMAINS)
        return index_table.read(s, path).groupBy("crawl_year", "base_domain").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("subset").alias("subsets"),
            F.count_if(F.col("note") == "warc").alias("noted"),
            F.sum("fetch_status").alias("statuses"),
        )

    def split(s, f):
        path = session.run_folder(s, "split")
        store.split_by_domain(Archive(s, f).captures().drop("base_domain"), path, DOMAINS)
        return s.read.parquet(path).groupBy("base_domain").agg(F.count(F.lit(1)).alias("n"))

    def split_index(s, f):
        path = session.run_folder(s, "split-index")
        store.split_by_domain(Archive(s, f).index().drop("base_domain"), path, DOMAINS, "url_surtkey")
        return store.read_domain(s, path, ONE_DOMAIN).groupBy("base_domain", "subset").agg(
            F.count(F.lit(1)).alias("n")
        )

    def migrate(s, f):
        a = Archive(s, f)
        old = session.run_folder(s, "unmigrated")
        store.write(a.captures().drop(*urls.SURT_COLUMNS[1:]), old)
        new = session.run_folder(s, "migrated")
        store.migrate_surt_columns(s.read.parquet(old), new)
        store.publish(s, "migrated_captures", new)
        return s.table("migrated_captures").groupBy(*urls.SURT_COLUMNS).agg(F.count(F.lit(1)).alias("n"))

    def backfill(s, f):
        a = Archive(s, f)
        path = session.run_folder(s, "backfilled")
        store.write(without_dns(a).where(F.col("base_domain") != "other"), path)
        for _ in range(2):  # the second run must add nothing
            store.backfill_dns(s, a.lines(), path, cdxj.year_from_path(), DOMAINS)
        return key_counts(store.read(s, path))

    def propagate(s, f):
        a = Archive(s, f)
        path = session.run_folder(s, "one-domain")
        full = a.captures().drop("base_domain")
        store.write(
            without_dns(a).drop("base_domain").where(dom.is_one_domain("surtkey", ONE_DOMAIN)),
            path,
            partitions=[],
        )
        for _ in range(2):
            store.propagate_dns(full, path, ONE_DOMAIN)
        return s.read.parquet(path).groupBy("crawl_year", "mime").agg(F.count(F.lit(1)).alias("n"))

    def streamed(s, f):
        a = Archive(s, f)
        path, mark = session.run_folder(s, "streamed"), session.run_folder(s, "stream-mark")
        for _ in range(2):
            stream = ingest.capture_stream(s, a.lines_path(), "*.gz")
            ingest.load_new_files(stream, path, mark, DOMAINS)
        return key_counts(store.read(s, path))

    def streamed_unseen(s, f):
        a = Archive(s, f)
        path = session.run_folder(s, "unseen")
        for _ in range(2):  # a fresh checkpoint each time: every file is replayed
            stream = ingest.capture_stream(s, a.lines_path(), "*.gz")
            ingest.append_unseen(stream, path, session.run_folder(s, "unseen-mark"), DOMAINS)
        return key_counts(store.read(s, path))

    def lost_checkpoint(append):
        """One year streamed, the checkpoint lost, then the whole archive, twice."""

        def run(s, f):
            a = Archive(s, f)
            path = session.run_folder(s, "lost-checkpoint")
            first, mark = f"{a.lines_path()}/crawl=CRAWL-2016", session.run_folder(s, "lost-mark")
            append(ingest.capture_stream(s, first, "*.gz"), path, mark, DOMAINS)
            store.remove(s, mark)
            for _ in range(2):
                append(ingest.capture_stream(s, a.lines_path(), "*.gz"), path, mark, DOMAINS)
            return key_counts(store.read(s, path))

        return run

    def streamed_without_years(s, f):
        """Captures of no year, redelivered to a fresh checkpoint under other file names."""
        a = Archive(s, f)
        path, copy = session.run_folder(s, "yearless"), session.run_folder(s, "yearless-copy")
        s.read.option("recursiveFileLookup", "true").text(a.lines_path()).write.option("compression", "gzip").text(copy)
        for i, folder in enumerate((a.lines_path(), copy)):
            stream = ingest.capture_stream(s, folder, "*.gz", "no year in (this) path")
            ingest.append_unseen(stream, path, session.run_folder(s, f"yearless-mark{i}"), DOMAINS)
        return key_counts(store.read(s, path))

    def streamed_half(s, f):
        """A batch that wrote rows and died before its load counted is run again."""
        a = Archive(s, f)
        path, mark = session.run_folder(s, "half-batch"), session.run_folder(s, "half-mark")
        ingest.load_new_files(ingest.capture_stream(s, a.lines_path(), "*.gz"), path, mark, DOMAINS)
        store.remove(s, f"{path}/_live")
        store.remove(s, f"{mark}/commits")
        ingest.load_new_files(ingest.capture_stream(s, a.lines_path(), "*.gz"), path, mark, DOMAINS)
        return key_counts(store.read(s, path))

    def exported(s, f):
        path = session.run_folder(s, "csv")
        store.write_csv(_reports()["q31_domain_year_matrix"](s, f), path)
        schema = "folder string, " + ", ".join(
            f"`{y} {src}` bigint" for src in reconcile.SOURCES for y in [*YEARS, "ALL"]
        )
        return s.read.schema(schema).option("header", "true").csv(path)

    def materialised(s, f):
        a = Archive(s, f)
        table = store.materialise(hosts.host_paths_of(a.captures()), session.run_folder(s, "paths"))
        store.create_temp_view(table, "host_paths")
        return s.sql("SELECT host, count(*) AS n FROM host_paths GROUP BY host")

    def structure_report(name: str) -> Query:
        def run(s, f):
            a = Archive(s, f)
            return structure.url_structure_report(
                a.captures(), base=a.report_base(), limit=30, frames=[name]
            )[name]

        return run

    return {
        "snk_load_years": load_table,
        "snk_load_replace": load_replace,
        "snk_load_absent_year": load_absent_year,
        "snk_load_quarantine": load_quarantine,
        "snk_backfill_interrupted": backfill_interrupted,
        "str_stream_then_append": stream_then_append,
        "str_stream_quarantine": stream_quarantine,
        "snk_split_by_domain": split,
        "snk_split_index": split_index,
        "snk_migrate_surt_columns": migrate,
        "snk_backfill_dns": backfill,
        "snk_propagate_dns": propagate,
        "snk_csv_export": exported,
        "snk_materialised_view": materialised,
        "snk_report_base_refreshed": refreshed_base,
        "snk_size_histogram_refreshed": refreshed_sizes,
        "snk_propagate_dns_all": propagate_all,
        "snk_propagate_dns_counts": propagate_counts,
        "snk_split_key_ranges": split_ranges,
        "snk_load_index": load_index,
        "snk_load_index_counts": load_index_counts,
        "snk_load_index_evolved": load_index_evolved,
        "snk_load_interrupted": load_interrupted,
        "snk_load_counts": load_counts,
        "snk_load_quarantine_repeated": load_quarantine_repeated,
        "str_lost_checkpoint": lost_checkpoint(ingest.load_new_files),
        "str_unseen_lost_checkpoint": lost_checkpoint(ingest.append_unseen),
        "str_unseen_without_years": streamed_without_years,
        "str_half_batch": streamed_half,
        "str_load_new_files": streamed,
        "str_append_unseen": streamed_unseen,
        **{
            f"snk_structure_{n}": structure_report(n)
            for n in structure.REPORT_FRAMES
            if n != "path_heat"
        },
        "snk_structure_path_heat": lambda s, f: _rounded_logs(structure_report("path_heat")(s, f)),
    }


def queries() -> dict[str, Query]:
    return {**_reports(), **_sources(), **_tables()}

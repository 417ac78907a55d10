"""Path, file-type and subdomain structure of the captures, by crawl year.

Every report takes captures, or a frame made by ``rollups.compact`` that
carries the columns it groups by. ``within=["base_domain"]`` computes it for
all domains in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtscope.config import CRAWL_YEARS, SURT_PATH_DEPTH
from surtscope.functions import urls
from surtscope.functions.measures import WEIGHT, rows_of, rows_where, share_pct
from surtscope.operators import rollups as roll
from surtscope.plans.overview import subdomain_breakdown, subdomain_label, unique_subdomains

ROOT, NONE = "(root)", "(none)"


def _ext(df: DataFrame) -> Column:
    return urls.stored_or(df, "ext", urls.extension())


def _ext_label(df: DataFrame) -> Column:
    return urls.label_if_empty(_ext(df), NONE)


def _seg1(df: DataFrame) -> DataFrame:
    return df.withColumn("seg1", urls.label_if_empty("surtpath_1", ROOT))


def _ordered(wide: DataFrame, keys: list[str], within: list[str], limit: int | None) -> DataFrame:
    order = [F.col("total").desc(), *[F.col(k).asc_nulls_last() for k in keys]]
    if limit is None:
        return wide.orderBy(*within, *order)
    return roll.top_k(wide, limit, order, within)


def path_prefixes(
    captures: DataFrame,
    depth: int,
    years=CRAWL_YEARS,
    limit: int | None = None,
    root_label: str | None = None,
    within: list[str] | None = None,
) -> DataFrame:
    """Captures per path prefix of ``depth`` segments and year.

    An empty first segment is ``(root)`` at depth 1 and ``(none)`` deeper,
    unless ``root_label`` names one label for all depths.
    """
    within = within or []
    first = root_label or (ROOT if depth == 1 else NONE)
    labels = {"seg1": urls.label_if_empty("surtpath_1", first)}
    for i in range(2, depth + 1):
        labels[f"seg{i}"] = urls.label_if_empty(f"surtpath_{i}", NONE)
    keys = list(labels)
    wide = roll.year_pivot(captures.withColumns(labels), [*within, *keys], years)
    return _ordered(wide, keys, within, limit)


def paths_seen_in(
    captures: DataFrame, wanted: list[str], years=CRAWL_YEARS, within: list[str] | None = None
) -> DataFrame:
    """First segments captured in at least one of the wanted years."""
    within = within or []
    wide = roll.year_pivot(_seg1(captures), [*within, "seg1"], years)
    return (
        wide.where(roll.row_sum(wanted) > 0)
        .select(*within, "seg1", *wanted, "total")
        .orderBy(*within, F.col(wanted[0]).desc(), "seg1")
    )


def extensions(captures, years=CRAWL_YEARS, limit: int | None = None, within=None) -> DataFrame:
    within = within or []
    rows = captures.withColumn("ext", _ext_label(captures))
    return _ordered(roll.year_pivot(rows, [*within, "ext"], years), ["ext"], within, limit)


def filenames(captures, years=CRAWL_YEARS, limit: int | None = None, within=None) -> DataFrame:
    within = within or []
    name = urls.stored_or(captures, "filename", urls.filename())
    rows = captures.withColumn("filename", urls.label_if_empty(name, ROOT))
    return _ordered(roll.year_pivot(rows, [*within, "filename"], years), ["filename"], within, limit)


def top_subdomains_by_year(captures: DataFrame, k: int = 8, within=None) -> DataFrame:
    """Year x subdomain in long form, all but the k largest labels as ``other``."""
    within = within or []
    rows = captures.where(F.col("surtkey").isNotNull()).withColumn(
        "subdomain", subdomain_label(captures, "top")
    )
    counts = roll.count_by(rows, [*within, "crawl_year", "subdomain"])
    folded = roll.tail_as(counts, "subdomain", k, within=within)
    return (
        folded.groupBy(*within, "crawl_year", "subdomain")
        .agg(F.sum("n").alias("n"))
        .orderBy(*within, "crawl_year", F.col("n").desc(), "subdomain")
    )


def path_heat(captures: DataFrame, k: int = 15, years=CRAWL_YEARS, within=None) -> DataFrame:
    """Counts and ``log(1 + count)`` per year of the k largest first segments."""
    within = within or []
    wide = roll.year_pivot(_seg1(captures), [*within, "seg1"], years).where(F.col("seg1") != ROOT)
    top = roll.top_k(wide, k, [F.col("total").desc(), F.col("seg1")], within)
    return top.select(
        *within, "seg1", *years, *[F.log1p(F.col(y)).alias(f"log_{y}") for y in years]
    )


def _years_of_segments(captures: DataFrame, within: list[str]) -> DataFrame:
    """One row per first segment with the array of years it was captured in."""
    return _seg1(captures).groupBy(*within, "seg1").agg(F.collect_set("crawl_year").alias("_years"))


def path_churn(captures: DataFrame, years=None, within=None) -> DataFrame:
    """First segments in only one, or in both, of the two latest years that a group has.

    ``years`` limits the choice; without it all years of the captures count. A group of
    one year has no pair and no rows. The pair is found in the query itself: no job runs
    beforehand, and the plan does not grow with the number of years.
    """
    within = within or []
    rows = captures.where(F.col("crawl_year").isin(*years)) if years else captures
    segments = _years_of_segments(rows, within)
    newest = F.slice(F.sort_array(F.collect_set("crawl_year"), asc=False), 1, 2)
    if within:
        pairs = rows.groupBy(*within).agg(newest.alias("_pair"))
        same = [F.col(f"s.`{c}`").eqNullSafe(F.col(f"p.`{c}`")) for c in within]
        paired = segments.alias("s").join(pairs.alias("p"), same).select("s.*", "p._pair")
    else:
        paired = segments.withColumn("_pair", rows.agg(newest).scalar())
    paired = paired.where(F.size("_pair") == 2).withColumns(
        {"_a": F.get("_pair", F.lit(1)), "_b": F.get("_pair", F.lit(0))}
    )
    in_a, in_b = F.array_contains("_years", F.col("_a")), F.array_contains("_years", F.col("_b"))
    categories = F.array(
        F.struct(F.concat(F.lit("Only in "), "_a").alias("category"), F.count_if(in_a & ~in_b).alias("count")),
        F.struct(F.lit("In both").alias("category"), F.count_if(in_a & in_b).alias("count")),
        F.struct(F.concat(F.lit("Only in "), "_b").alias("category"), F.count_if(~in_a & in_b).alias("count")),
    )
    counted = paired.groupBy(*within, "_a", "_b").agg(categories.alias("latest"))
    return counted.select(*within, F.inline("latest"))


def path_churn_all_periods(captures: DataFrame, years=None, within=None) -> DataFrame:
    """The same for every pair of adjacent years (of the captures, if none are given)."""
    within = within or []
    segments = _years_of_segments(captures, within)
    if years:
        ordered = F.array(*[F.lit(y) for y in sorted(years)])
    else:
        ordered = captures.agg(F.sort_array(F.collect_set("crawl_year"))).scalar()
    steps = segments.withColumn("_ordered", ordered)
    place = F.explode(F.when(F.size("_ordered") > 1, F.sequence(F.lit(1), F.size("_ordered") - 1)))
    steps = steps.select(*within, "_years", "_ordered", place.alias("_k")).withColumns(
        {"_a": F.get("_ordered", F.col("_k") - 1), "_b": F.get("_ordered", F.col("_k"))}
    )
    in_a, in_b = F.array_contains("_years", F.col("_a")), F.array_contains("_years", F.col("_b"))
    counted = steps.groupBy(*within, "_a", "_b").agg(
        F.count_if(in_a & ~in_b).alias("Disappeared"),
        F.count_if(in_a & in_b).alias("Persisted"),
        F.count_if(~in_a & in_b).alias("New"),
    )
    return counted.orderBy(*within, "_a").select(
        *within, F.concat("_a", F.lit("→"), "_b").alias("period"), "Disappeared", "Persisted", "New"
    )


def extension_totals(captures: DataFrame, k: int = 10, within=None) -> DataFrame:
    """Top k extensions and everything else as ``(other)``."""
    within = within or []
    rows = captures.withColumn("ext", _ext_label(captures))
    totals = roll.count_by(rows, [*within, "ext"], "total")
    return roll.top_k_with_rest(totals, "ext", k, "total", within=within)


def extension_shift(captures: DataFrame, k: int = 10, years=CRAWL_YEARS, within=None) -> DataFrame:
    """Year counts of the k largest extensions, captures without one left out."""
    within = within or []
    wide = extensions(captures, years, None, within).where(F.col("ext") != NONE)
    return roll.top_k(wide, k, [F.col("total").desc(), F.col("ext")], within).drop("total")


def top_paths(captures: DataFrame, k: int = 20, within=None) -> DataFrame:
    """Largest first segments over all years, the root left out."""
    within = within or []
    counts = roll.count_by(_seg1(captures), [*within, "seg1"]).where(F.col("seg1") != ROOT)
    return roll.top_k(counts, k, [F.col("n").desc(), F.col("seg1")], within)


def top_paths_per_year(captures: DataFrame, k: int = 20, within=None) -> DataFrame:
    within = within or []
    counts = roll.count_by(_seg1(captures), [*within, "crawl_year", "seg1"])
    return roll.top_k(counts, k, [F.col("n").desc(), F.col("seg1")], [*within, "crawl_year"])


def pdf_per_year(captures: DataFrame, within=None) -> DataFrame:
    within = within or []
    return roll.count_by(
        captures.where(_ext(captures) == "pdf"), [*within, "crawl_year"]
    ).orderBy(*within, "crawl_year")


def path_depth(captures: DataFrame, within=None) -> DataFrame:
    """Depth of non-root paths per year.

    A depth is at most the length of a URL, so the exact median keeps only a
    short list of distinct depths per year.
    """
    within = within or []
    depth = urls.stored_or(captures, "depth", urls.path_depth())
    rows = captures.where(F.col("surtpath_1") != "").withColumn("depth", depth)
    weight = F.col(WEIGHT) if WEIGHT in captures.columns else F.lit(1)
    return (
        rows.groupBy(*within, "crawl_year")
        .agg(
            rows_of(captures).alias("n"),
            (F.sum(F.col("depth") * weight) / rows_of(captures)).alias("avg_depth"),
            F.percentile("depth", 0.5, weight).alias("median_depth"),
            F.max("depth").alias("max_depth"),
        )
        .orderBy(*within, "crawl_year")
    )


def clean_urls(captures: DataFrame, within=None) -> DataFrame:
    """Captures whose path has no extension against those that have one."""
    within = within or []
    ext = _ext(captures)
    return (
        captures.groupBy(*within, "crawl_year")
        .agg(
            rows_where(captures, ext == "").alias("clean_urls"),
            rows_where(captures, ext != "").alias("static_files"),
            rows_of(captures).alias("total"),
        )
        .withColumn("clean_pct", share_pct(F.col("clean_urls"), F.col("total"), 1))
        .orderBy(*within, "crawl_year")
    )


def _pdf_names(captures: DataFrame) -> DataFrame:
    name = urls.stored_or(captures, "pdf_name", urls.pdf_name())
    return captures.where(_ext(captures) == "pdf").withColumn("pdf_name", name)


def pdf_names(captures, years=CRAWL_YEARS, limit: int | None = None, within=None) -> DataFrame:
    within = within or []
    wide = roll.year_pivot(_pdf_names(captures), [*within, "pdf_name"], years)
    return _ordered(wide, ["pdf_name"], within, limit)


def unique_pdf_names(captures: DataFrame, within=None) -> DataFrame:
    return _pdf_names(captures).groupBy(*(within or [])).agg(
        F.count_distinct("pdf_name").alias("unique_names")
    )


def summary(captures: DataFrame, within=None) -> DataFrame:
    """Captures and crawl years, what a report of one domain opens with."""
    return captures.groupBy(*(within or [])).agg(
        rows_of(captures).alias("captures"),
        F.count_distinct("crawl_year").alias("years"),
        F.min("crawl_year").alias("first_year"),
        F.max("crawl_year").alias("last_year"),
    )


def node_ids(captures: DataFrame, within=None) -> DataFrame:
    """Numeric ids under ``/node/`` per year.

    Counted per (year, second segment) first, so the distinct count and the
    sums share one small frame.
    """
    within = within or []
    small = roll.count_by(
        captures.where(F.col("surtpath_1") == "node"), [*within, "crawl_year", "surtpath_2"]
    )
    node = F.col("surtpath_2").try_cast("int")
    return (
        small.groupBy(*within, "crawl_year")
        .agg(
            F.sum("n").alias("node_urls"),
            F.min(node).alias("min_node_id"),
            F.max(node).alias("max_node_id"),
            F.count("surtpath_2").alias("unique_nodes"),
        )
        .orderBy(*within, "crawl_year")
    )


def mime_by_extension(captures: DataFrame, within=None) -> DataFrame:
    within = within or []
    rows = captures.withColumn("ext", _ext_label(captures))
    return roll.most_frequent_first(
        roll.count_by(rows, [*within, "mime", "ext"]), "n", *within, "mime", "ext"
    )


# Columns the per-domain report groups by; file names stay out because there
# are nearly as many of them as captures.
_REPORT_KEYS = [
    "crawl_year",
    "surthost_seg_2",
    *[f"surtpath_{i}" for i in range(1, SURT_PATH_DEPTH + 1)],
    "ext",
    "depth",
    "mime",
]


def report_base(captures: DataFrame, within: list[str]) -> DataFrame:
    """Compact frame from which most of the URL-structure report is computed.

    Every capture is counted; of its SURT key only whether there is one is kept.
    """
    ready = captures.withColumns(
        {
            "ext": _ext(captures),
            "depth": urls.stored_or(captures, "depth", urls.path_depth()),
            "surtkey": F.when(F.col("surtkey").isNotNull(), F.lit("")),
        }
    )
    return roll.compact(ready, [*within, "surtkey", *_REPORT_KEYS])


# name -> (reads the compact base or the captures, report)
_REPORT = {
    "summary": ("base", lambda d, y, w, k: summary(d, w)),
    "unique_subdomains": ("base", lambda d, y, w, k: unique_subdomains(d, within=w)),
    "unique_pdf_names": ("captures", lambda d, y, w, k: unique_pdf_names(d, w)),
    "captures_per_year": ("base", lambda d, y, w, k: roll.count_by(d, [*w, "crawl_year"], "captures")),
    "host_years": ("captures", lambda d, y, w, k: roll.count_by(d, [*w, "host", "crawl_year"])),
    "subdomains": ("base", lambda d, y, w, k: subdomain_breakdown(d, y, k, within=w)),
    "subdomain_years": ("base", lambda d, y, w, k: top_subdomains_by_year(d, within=w)),
    "extensions": ("base", lambda d, y, w, k: extensions(d, y, k, w)),
    "filenames": ("captures", lambda d, y, w, k: filenames(d, y, k, w)),
    "path_heat": ("base", lambda d, y, w, k: path_heat(d, years=y, within=w)),
    "path_churn": ("base", lambda d, y, w, k: path_churn(d, y, w)),
    "path_churn_all_periods": ("base", lambda d, y, w, k: path_churn_all_periods(d, y, w)),
    "extension_totals": ("base", lambda d, y, w, k: extension_totals(d, within=w)),
    "extension_shift": ("base", lambda d, y, w, k: extension_shift(d, years=y, within=w)),
    "top_paths": ("base", lambda d, y, w, k: top_paths(d, within=w)),
    "top_paths_per_year": ("base", lambda d, y, w, k: top_paths_per_year(d, within=w)),
    "pdf_per_year": ("base", lambda d, y, w, k: pdf_per_year(d, w)),
    "path_depth": ("base", lambda d, y, w, k: path_depth(d, w)),
    "clean_urls": ("base", lambda d, y, w, k: clean_urls(d, w)),
    "pdf_names": ("captures", lambda d, y, w, k: pdf_names(d, y, k, w)),
    "node_ids": ("base", lambda d, y, w, k: node_ids(d, w)),
    "mime_by_extension": ("base", lambda d, y, w, k: mime_by_extension(d, w)),
    **{
        f"path_prefixes_{depth}": (
            "base",
            lambda d, y, w, k, depth=depth: path_prefixes(d, depth, y, k, within=w),
        )
        for depth in range(1, SURT_PATH_DEPTH + 1)
    },
}
REPORT_FRAMES = list(_REPORT)


def url_structure_report(
    captures: DataFrame,
    years=CRAWL_YEARS,
    within: list[str] | None = None,
    base: DataFrame | None = None,
    limit: int | None = None,
    frames: list[str] | None = None,
) -> dict[str, DataFrame]:
    """URL-structure frames (all, or the named ones) for every domain at once.

    Pass ``base`` when :func:`report_base` was written to a table, so that the
    frames read that instead of the captures; only the host and file-name
    frames need the captures.
    """
    within = ["base_domain"] if within is None else within
    if base is None:
        base = report_base(captures, within)
    inputs = {"base": base, "captures": captures}
    made = {}
    for name in frames or REPORT_FRAMES:
        source, report = _REPORT[name]
        made[name] = report(inputs[source], years, within, limit)
    return made

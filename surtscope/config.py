"""Parameters shared by sources, tables and reports."""

from __future__ import annotations

from collections.abc import Iterable

# Crawl years and the default target domains.
CRAWL_YEARS = ("2004", "2008", "2012", "2016", "2020", "2024")
TARGET_DOMAINS = (
    "usda.gov",
    "commerce.gov",
    "defense.gov",
    "ed.gov",
    "energy.gov",
    "hhs.gov",
    "dhs.gov",
    "hud.gov",
    "doi.gov",
    "justice.gov",
    "dol.gov",
    "state.gov",
    "transportation.gov",
    "treasury.gov",
    "va.gov",
)

# One folder per crawl year, ``<archive>-YYYY``. The archive's own name goes in
# as ``prefix``; the year is read from the last such folder of a path.
YEAR_FOLDER_PREFIX = "CRAWL-"
YEAR_IN_PATH = r".*[A-Za-z]-(\d{4})/"

# How many labels and path segments become columns of their own.
PATH_DEPTH = 5
SURT_HOST_DEPTH = 6
SURT_PATH_DEPTH = 5


def resolve_years(years: str | Iterable, allowed: Iterable[str] = CRAWL_YEARS) -> list[str]:
    """Normalise a year argument: a list of years, or ``"all"``.

    A year outside ``allowed`` is an error rather than an empty result.
    """
    allowed = [str(y) for y in allowed]
    if isinstance(years, str):
        years = allowed if years == "all" else [years]
    wanted = [str(y) for y in years]
    if wanted == ["all"]:
        wanted = allowed
    unknown = [y for y in wanted if y not in allowed]
    if unknown:
        raise ValueError(f"unknown crawl year(s) {unknown}; expected some of {allowed}")
    return wanted

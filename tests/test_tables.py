"""Loading, splitting, migrating, backfilling and publishing tables."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from surtscope.functions import urls
from surtscope.sources import cdxj, index, inventory
from surtscope.plans import content, structure
from surtscope.streaming import ingest
from surtscope.tables import report_table, store

from test_cdxj import BROKEN, DNS_LINE, FINE, GOOD, write

TARGETS = ("doi.gov", "ed.gov")
YEARS = ("2020", "2024")


def line(key, url, year="2024", mime="text/html", n=0):
    return f'{key} {year}0105120{n:03d} {{"url":"{url}","mime":"{mime}","status":"200","length":"10","offset":"{n}"}}'


@pytest.fixture
def archive(tmp_path):
    """Two crawl years of capture files with DNS records, broken lines and other domains."""
    for year in YEARS:
        body = [line("gov,doi)/", "http://doi.gov/", year, n=i) for i in range(30)]
        body += [line("gov,doi,data)/a/b.pdf", "http://data.doi.gov/a/b.pdf", year)]
        body += [line("gov,other)/", "http://other.gov/", year)]
        body += [b for b, _ in BROKEN[:4]]
        write(tmp_path / "cdxj" / f"CRAWL-{year}", "one.cdxj.gz", body)
    write(tmp_path / "cdxj" / "CRAWL-2024", "two.cdxj.gz", [DNS_LINE, GOOD, *FINE[2:4]])
    return tmp_path


@pytest.fixture
def load(spark, archive):
    def run(years="all", name="t", mode="append"):
        path = str(archive / name)
        n = store.load_years(spark, str(archive / "cdxj"), path, years, TARGETS, YEARS, mode=mode)
        return path, n

    return run


def test_load_counts_what_it_writes(spark, load):
    path, n = load()
    table = store.read(spark, path)
    assert n == table.count() == 31 * 2 + 2
    assert table.columns[:34] == cdxj.CAPTURE_COLUMNS
    assert {r[0] for r in table.select("base_domain").distinct().collect()} == {"doi.gov", "ed.gov"}
    assert dict(table.dtypes)["crawl_year"] == "string"


def test_load_writes_its_quarantine(spark, archive):
    n = store.load_years(
        spark, str(archive / "cdxj"), str(archive / "q"), ["2020"], TARGETS, YEARS, quarantine=str(archive / "bad")
    )
    bad = spark.read.option("header", "true").csv(str(archive / "bad"))
    assert (n, bad.count()) == (31, 4)


def test_load_of_chosen_years(spark, load):
    path, n = load(["2020"])
    assert n == 31
    with pytest.raises(ValueError):
        load(["2013"], "u")


def test_replacing_load_can_be_repeated(spark, load):
    path, n = load()
    for years in ("all", ["2020"]):
        load(years, mode="replace")
        assert store.read(spark, path).count() == n


def test_replacing_load_clears_its_years_only(spark, load, archive):
    path, n = load()
    rows = store.read(spark, path)
    kept = rows.where("crawl_year <> '2020'").count()
    again = store.load_years(
        spark, str(archive / "cdxj"), path, ["2020"], ["ed.gov"], YEARS, mode="replace"
    )
    assert again == rows.where("crawl_year = '2020' and base_domain = 'ed.gov'").count()
    assert store.read(spark, path).count() == kept + again


def test_load_names_absent_years_and_keeps_broken_lines(spark, load, archive):
    path, out = load(["2020"])[0], str(archive / "absent")
    with pytest.warns(UserWarning, match="2099"):
        n = store.load_years(spark, str(archive / "cdxj"), out, ["2020", "2099"], TARGETS, [*YEARS, "2099"])
    assert n == store.read(spark, path).count() == store.read(spark, out).count()
    assert spark.read.option("header", "true").csv(f"{out}-errors").count() == 4
    with pytest.raises(FileNotFoundError):
        store.load_years(spark, str(archive / "cdxj"), out, ["2099"], TARGETS, ["2099"])


def test_published_view_keeps_years_as_strings(spark, load):
    path, n = load()
    store.publish(spark, "captures_view", path)
    view = spark.table("captures_view")
    assert dict(view.dtypes)["crawl_year"] == "string"
    assert view.where("crawl_year = '2020'").count() == 31


def test_append_uses_column_names(spark, load):
    path, n = load(["2020"])
    rows = store.read(spark, path).limit(3)
    shuffled = rows.select(*reversed(rows.columns))
    assert store.append(shuffled, path) == 3
    assert store.read(spark, path).where("surthost like 'gov%'").count() == n + 3
    with pytest.raises(ValueError):
        store.append(rows.drop("url"), path)


def test_partition_filters_skip_folders(spark, load):
    path, _ = load()
    df = store.read(spark, path).where((F.col("base_domain") == "ed.gov") & (F.col("crawl_year") == "2024"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(base_domain" in plan.replace("crawl_year", "base_domain")
    assert df.count() == 1


def test_split_by_domain(spark, load, archive):
    path, n = load()
    out = str(archive / "split")
    assert store.split_by_domain(store.read(spark, path).drop("base_domain"), out, TARGETS) == n
    assert store.read_domain(spark, out, "ed.gov").count() == 1
    assert store.read_domain(spark, out, "doi.gov").count() == n - 1


def test_migration_adds_columns_once(spark, load, archive):
    path, n = load()
    full = store.read(spark, path)
    assert store.migrate_surt_columns(full, str(archive / "none")) is None
    for missing in (urls.SURT_COLUMNS, urls.SURT_COLUMNS[3:]):
        new = str(archive / f"new{len(missing)}")
        old = full.drop(*missing)
        assert store.migrate_surt_columns(old, new) == new
        got = spark.read.parquet(new)
        assert got.count() == n and set(urls.SURT_COLUMNS) <= set(got.columns)
        want = full.select("url", "fetch_timestamp", *urls.SURT_COLUMNS)
        assert got.select(*want.columns).exceptAll(want).isEmpty()
    with pytest.raises(ValueError):
        store.migrate_surt_columns(full.drop("surtkey", "surtpath_1"), str(archive / "bad"))


def test_failed_migration_leaves_the_old_table(spark, load, archive):
    """A run that dies before the switch can be repeated under another path."""
    path, n = load()
    store.publish(spark, "captures_now", path)
    half = str(archive / "half")
    old = store.read(spark, path).drop(*urls.SURT_COLUMNS)
    store.migrate_surt_columns(old, half)  # written, never published
    assert spark.table("captures_now").count() == n
    done = store.migrate_surt_columns(old, str(archive / "again"))
    store.publish(spark, "captures_now", done)
    assert spark.table("captures_now").count() == n
    assert "surtpath_5" in spark.table("captures_now").columns


def test_dns_backfill_is_idempotent(spark, load, archive):
    path, n = load()
    bare = str(archive / "bare")
    no_dns = store.read(spark, path).where("mime <> 'text/dns' or mime is null")
    store.write(no_dns, bare)
    lines = cdxj.read_lines(spark, [str(archive / "cdxj" / f"CRAWL-{y}") for y in YEARS])
    year = cdxj.year_from_path()
    assert store.backfill_dns(spark, lines, bare, year, TARGETS) == 1
    assert store.backfill_dns(spark, lines, bare, year, TARGETS) == 0
    assert store.read(spark, bare).count() == n


def test_dns_propagation(spark, load, archive):
    path, _ = load()
    full = store.read(spark, path)
    one = str(archive / "one")
    store.write(full.where("base_domain = 'ed.gov' and mime <> 'text/dns'"), one, partitions=[])
    assert store.propagate_dns(full, one, "ed.gov", store.table_schema()) == 1
    assert store.propagate_dns(full, one, "ed.gov", store.table_schema()) == 0
    with pytest.raises(store.SchemaMismatch, match="missing in target"):
        store.propagate_dns(full.withColumn("extra", F.lit(1)), one, "ed.gov")


def test_conversion_keeps_good_lines(spark, archive):
    lines = cdxj.read_lines(spark, str(archive / "cdxj" / "CRAWL-2024"))
    out = str(archive / "converted")
    assert store.convert_cdxj(lines, out) == 32 + 4
    assert spark.read.parquet(out).columns == cdxj.RAW_COLUMNS


def test_quarantine_export(spark, archive):
    lines = cdxj.read_lines(spark, str(archive / "cdxj" / "CRAWL-2020"))
    out = str(archive / "errors")
    store.write_csv(cdxj.errors(lines), out)
    got = spark.read.option("header", "true").csv(out)
    assert got.columns == ["file", "line", "error_type", "error_message", "raw_line_preview"]
    assert sorted(int(r.line) for r in got.collect()) == [33, 34, 35, 36]


def test_stream_equals_batch_and_loads_once(spark, load, archive, collect):
    path, n = load()
    out, mark = str(archive / "s"), str(archive / "mark")
    for _ in range(2):
        stream = ingest.capture_stream(spark, str(archive / "cdxj"))
        ingest.load_new_files(stream, out, mark, TARGETS)
    streamed = store.read(spark, out)
    assert collect(streamed) == collect(store.read(spark, path).select(*streamed.columns))
    write(archive / "cdxj" / "CRAWL-2024", "late.cdxj.gz", [line("gov,ed)/late", "http://ed.gov/late")])
    ingest.load_new_files(ingest.capture_stream(spark, str(archive / "cdxj")), out, mark, TARGETS)
    assert store.read(spark, out).count() == n + 1


def test_streamed_table_takes_appends_and_repeated_batches(spark, load, archive):
    path, n = load()
    out, mark = str(archive / "plain"), str(archive / "plain-mark")
    ingest.load_new_files(ingest.capture_stream(spark, str(archive / "cdxj")), out, mark, TARGETS)
    assert store.append(store.read(spark, path).limit(2), out) == 2
    assert store.read(spark, out).count() == n + 2
    assert spark.read.option("header", "true").csv(f"{out}-errors").count() == 8
    store.remove(spark, f"{mark}-ledger/0.done")  # as if the batch had failed half way
    store.remove(spark, f"{mark}/commits")
    ingest.load_new_files(ingest.capture_stream(spark, str(archive / "cdxj")), out, mark, TARGETS)
    assert store.read(spark, out).count() == n + 2


def test_unseen_append_survives_a_lost_checkpoint(spark, load, archive):
    _, n = load()
    out = str(archive / "u")
    for i in range(2):
        stream = ingest.capture_stream(spark, str(archive / "cdxj"), files_per_batch=1)
        ingest.append_unseen(stream, out, str(archive / f"mark{i}"), TARGETS)
    assert store.read(spark, out).count() == n


def test_index_sources(spark, archive, rows):
    root = archive / "index"
    for y, extra in (("2020", "a"), ("2024", "b")):
        rows(f"url string, {extra} string", ("u" + y, y)).write.parquet(str(root / f"crawl=CRAWL-{y}"))
    folders = {y: str(root / f"crawl=CRAWL-{y}") for y in YEARS}
    both = index.read_years(spark, folders, "all", YEARS)
    assert {(r.url, r.a, r.b, r.crawl_year) for r in both.collect()} == {
        ("u2020", "2020", None, "2020"),
        ("u2024", None, "2024", "2024"),
    }
    pruned = index.read_partitioned(spark, str(root)).where("crawl = 'CRAWL-2020'")
    assert [r.crawl_year for r in pruned.collect()] == ["2020"]
    named = index.with_year_from_file(index.read_recursive(spark, str(root)))
    assert sorted(r.crawl_year for r in named.select("crawl_year").collect()) == ["2020", "2024"]
    files = index.file_count(spark, str(root)).first().files
    assert files == index.list_files(spark, str(root)).count() >= 2
    assert index.list_files(spark, str(root)).where("size > 0").count() == files


def test_inventory(spark, archive, rows, collect):
    write(archive, "cdx.paths.gz", [" x/a.cdxj.gz ", "", "x/b.cdxj.gz", "x/readme.txt"])
    listed = inventory.with_suffix(inventory.read_manifest(spark, str(archive / "cdx.paths.gz")), ".cdxj.gz")
    assert collect(listed) == [("x/a.cdxj.gz", None), ("x/b.cdxj.gz", None)]
    sized = rows("key string, size bigint", ("x/a", 5), ("x/b", 6), ("x/c", 7), ("x/d", None), ("x/e", None))
    local = rows("name string, size bigint", ("a", 5), ("b", 1), ("d", 9), ("d", 10))
    assert collect(inventory.pending(sized, local)) == [("x/b", 6), ("x/c", 7), ("x/e", None)]
    assert tuple(inventory.pending_summary(sized, local).first()) == (5, 3, 2, 13)


def test_shared_folder_setting_is_read_from_the_session(spark):
    from surtscope import session

    assert session.run_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert session.run_folder(spark, "x") != session.run_folder(spark, "x")


def shown(df, *columns):
    return sorted(map(str, (df.select(*columns) if columns else df).collect()))


def test_a_run_killed_before_the_switch_leaves_the_old_year(spark, load, archive, monkeypatch):
    path, n = load()
    before = shown(store.read(spark, path))
    store.publish(spark, "killed_view", path)

    def die(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store.loads, "publish", die)
        with pytest.raises(KeyboardInterrupt):
            store.load_years(spark, str(archive / "cdxj"), path, ["2020"], ["ed.gov"], YEARS, mode="replace")
    assert shown(store.read(spark, path)) == before
    assert store.read_quarantine(spark, path).count() == 8
    load(["2020"], mode="replace")
    assert shown(store.read(spark, path)) == before
    assert spark.table("killed_view").count() == n  # the view shows the list it was made from
    store.publish(spark, "killed_view", path)
    assert spark.table("killed_view").count() == n


def test_a_replaced_year_is_one_step_for_readers(spark, load):
    """A reader that started with the older list still finds its rows."""
    path, n = load()
    old = store.loads.live(spark, path)
    load(["2020"], mode="replace")
    assert store.loads.read(spark, path, store.table_schema(), old).count() == n
    assert store.read(spark, path).count() == n
    assert store.loads.vacuum(spark, path) == 1 and store.loads.vacuum(spark, path) == 0
    assert store.read(spark, path).count() == n


def test_two_writers_both_count(spark, load, archive):
    """The second to publish takes the first one's list as its base."""
    path, n = load(["2020"])
    rows = store.read(spark, path)
    first = store.loads.live(spark, path)
    store.append(rows.limit(2), path)
    assert store.files.create_once(spark, f"{path}/_live/{first.version + 1:08d}.json", "{}") is False
    store.append(rows.limit(3), path)
    assert store.read(spark, path).count() == n + 5


def test_repeated_replace_leaves_each_broken_line_once(spark, load):
    path, _ = load()
    for _ in range(3):
        load(mode="replace")
    raw = spark.read.option("header", "true").csv(f"{path}-errors")
    raw = raw.withColumns({"line": F.col("line").cast("long"), "raw_line_preview": F.coalesce("raw_line_preview", F.lit(""))})
    want = shown(raw, "file", "line", "error_type", "raw_line_preview")
    assert len(want) == len(set(want)) == 8
    assert shown(store.read_quarantine(spark, path), "file", "line", "error_type", "raw_line_preview") == want


def test_a_load_parses_the_archive_once(spark, load, archive, monkeypatch):
    """One text scan in all plans of a load, and the quarantine that two passes give."""
    texts = []
    parse = cdxj._parse
    monkeypatch.setattr(cdxj, "_parse", lambda lines: texts.append(1) or parse(lines))
    path, _ = load()
    assert len(texts) == 1
    lines = cdxj.read_lines(spark, str(archive / "cdxj"), recursive=True)
    assert shown(cdxj.errors(lines)) == shown(store.read_quarantine(spark, path), *cdxj.ERROR_COLUMNS)


def test_plain_tables_take_loads_and_streams(spark, load, archive):
    path, n = load()
    out = str(archive / "plain-first")
    rows = store.read(spark, path)
    store.write(rows.where("crawl_year = '2020'"), out)
    store.load_years(spark, str(archive / "cdxj"), out, ["2024"], TARGETS, YEARS)
    assert shown(store.read(spark, out)) == shown(rows)
    store.publish(spark, "mixed_view", out)
    assert shown(spark.table("mixed_view")) == shown(rows)
    store.load_years(spark, str(archive / "cdxj"), out, ["2020"], TARGETS, YEARS, mode="replace")
    assert shown(store.read(spark, out)) == shown(rows)
    store.publish(spark, "mixed_view", out)
    assert spark.table("mixed_view").count() == n
    again = str(archive / "plain-unseen")
    store.write(rows.where("crawl_year = '2020'").limit(5), again)
    ingest.append_unseen(ingest.capture_stream(spark, str(archive / "cdxj")), again, str(archive / "pu"), TARGETS)
    assert store.read(spark, again).count() == n


@pytest.mark.parametrize("run", [ingest.load_new_files, ingest.append_unseen])
def test_streams_after_a_lost_checkpoint_and_new_files(spark, load, archive, run):
    """The same checkpoint path, emptied; a file that came meanwhile; then once more."""
    _, n = load()
    out, mark = str(archive / "lost"), str(archive / "lost-mark")

    def go():
        run(ingest.capture_stream(spark, str(archive / "cdxj")), out, mark, TARGETS)
        return store.read(spark, out).count()

    assert go() == n
    store.remove(spark, mark)
    late = [line("gov,ed)/late", "http://ed.gov/late", n=i) for i in range(7)]
    write(archive / "cdxj" / "CRAWL-2024", "late.cdxj.gz", [*late, "broken"])
    assert [go(), go()] == [n + 7, n + 7]
    assert store.read_quarantine(spark, out).count() == spark.read.option("header", "true").csv(f"{out}-errors").count()


def test_unseen_append_of_lines_without_a_year(spark, archive):
    """Captures of no year are compared like others, also those that come in another file."""
    body = [line("gov,ed)/a", "http://ed.gov/a", n=i) for i in range(5)]
    write(archive / "bare", "one.cdxj.gz", body)
    out = str(archive / "bare-table")
    for i, extra in enumerate((0, 1, 2)):
        write(archive / "bare", f"more{i}.cdxj.gz", body[:3] + [line("gov,ed)/b", "http://ed.gov/b", n=k) for k in range(extra)])
        stream = ingest.capture_stream(spark, str(archive / "bare"), files_per_batch=1)
        ingest.append_unseen(stream, out, str(archive / f"bare-mark{i}"), TARGETS)
    table = store.read(spark, out)
    assert table.count() == 5 + 2 and table.where("crawl_year is null").count() == 7


def test_a_batch_that_dies_half_way_is_completed(spark, load, archive, monkeypatch):
    """Rows written, the load not listed: the next run gives exactly the captures."""
    _, n = load()
    publish, failures = store.loads.publish, []
    for run in (ingest.load_new_files, ingest.append_unseen):
        out, mark = str(archive / f"half-{run.__name__}"), str(archive / f"half-{run.__name__}-mark")

        def die(spark_, path, name, *rest, **more):
            if not failures:
                failures.append(name)
                raise RuntimeError("killed")
            return publish(spark_, path, name, *rest, **more)

        failures.clear()
        with monkeypatch.context() as m:
            m.setattr(store.loads, "publish", die)
            with pytest.raises(Exception, match="killed"):
                run(ingest.capture_stream(spark, str(archive / "cdxj")), out, mark, TARGETS)
            assert failures and store.read(spark, out).count() == 0
        for _ in range(2):
            run(ingest.capture_stream(spark, str(archive / "cdxj")), out, mark, TARGETS)
            assert store.read(spark, out).count() == n


def test_a_stream_does_not_load_what_a_batch_load_has_read(spark, load, archive):
    path, n = load()
    ingest.load_new_files(ingest.capture_stream(spark, str(archive / "cdxj")), path, str(archive / "after-batch"), TARGETS)
    assert store.read(spark, path).count() == n


def test_unseen_append_asks_its_state_and_not_the_table(spark, load, archive, monkeypatch):
    """Captures that another file repeats are dropped without a look at the table."""
    _, n = load()
    out, mark = str(archive / "keyed"), str(archive / "keyed-mark")
    ingest.append_unseen(ingest.capture_stream(spark, str(archive / "cdxj")), out, mark, TARGETS)
    again = [line("gov,doi)/", "http://doi.gov/", "2020", n=i) for i in range(30)] + [line("gov,ed)/new", "http://ed.gov/new", "2020")]
    write(archive / "cdxj" / "CRAWL-2020", "again.cdxj.gz", again)
    monkeypatch.setattr(ingest, "absent_from", None)
    ingest.append_unseen(ingest.capture_stream(spark, str(archive / "cdxj")), out, mark, TARGETS)
    assert store.read(spark, out).count() == n + 1


def test_report_base_follows_the_captures(spark, load, archive, monkeypatch):
    """Equal to a full rebuild after every kind of change, from the parts that changed."""
    base, reads = str(archive / "base"), []
    read = store.loads.read

    def watched(session, path, schema, table=None):
        if table is not None and not path.endswith("base"):
            reads.append({(x.name, y) for x in table.loads for y in x.live_years()})
        return read(session, path, schema, table)

    def check(years):
        with monkeypatch.context() as m:
            m.setattr(store.loads, "read", watched)
            reads.clear()
            assert report_table.refresh(spark, path, base) == years
        seen = {y for part in reads for _, y in part}
        whole = structure.report_base(store.read(spark, path), ["base_domain"])
        columns = whole.columns
        assert shown(report_table.read(spark, base), *columns) == shown(whole, *columns)
        assert report_table.refresh(spark, path, base) == []
        return seen

    path, _ = load(["2020"])
    assert check(["2020"]) == {"2020"}
    load(["2024"])
    assert check(["2024"]) == {"2024"}
    store.load_years(spark, str(archive / "cdxj"), path, ["2020"], ["ed.gov"], YEARS, mode="replace")
    assert check(["2020"]) == {"2020"}
    store.append(store.read(spark, path).where("mime = 'text/dns'"), path)
    assert check(["2024"]) == {"2024"}
    load(["2024"], mode="replace")
    store.loads.vacuum(spark, path)  # the replaced rows are gone: the year is counted anew
    assert check(["2024"]) == {"2024"}


def test_a_refresh_that_dies_changes_nothing(spark, load, archive, monkeypatch):
    path, n = load(["2020"])
    base = str(archive / "dying-base")
    report_table.refresh(spark, path, base)
    load(["2024"])
    with monkeypatch.context() as m:
        m.setattr(store.loads, "publish", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            report_table.refresh(spark, path, base)
    assert report_table.read(spark, base).agg(F.sum("capture_count")).first()[0] == n
    assert report_table.refresh(spark, path, base) == ["2024"]
    assert report_table.read(spark, base).agg(F.sum("capture_count")).first()[0] == store.read(spark, path).count()


def test_size_histogram_follows_the_captures(spark, load, archive):
    path, _ = load()
    sizes = str(archive / "sizes")
    report_table.refresh(spark, path, sizes, content.size_histogram)
    load(["2020"], mode="replace")
    store.append(store.read(spark, path).where("base_domain = 'ed.gov'"), path)
    assert report_table.refresh(spark, path, sizes, content.size_histogram) == ["2020", "2024"]
    stored = report_table.read(spark, sizes, content.size_histogram)
    assert shown(content.size_statistics(stored, TARGETS)) == shown(content.size_statistics(store.read(spark, path), TARGETS))
    plan = content.size_histogram(store.read(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_dns_goes_to_all_domains_at_once(spark, load, archive):
    path, _ = load()
    full = store.read(spark, path).drop("base_domain")
    root = str(archive / "domains")
    page = full.where("mime = 'text/dns'").withColumn("mime", F.lit("text/html"))
    full = full.union(page)
    store.split_by_domain(full.where("mime <> 'text/dns' or mime is null"), root, TARGETS)
    with pytest.warns(UserWarning, match="va.gov"):
        assert store.propagate_dns_all(full, root, [*TARGETS, "va.gov"]) == {"doi.gov": 0, "ed.gov": 1}
    assert store.propagate_dns_all(full, root, TARGETS) == {"doi.gov": 0, "ed.gov": 0}
    assert store.read_domain(spark, root, "ed.gov").where("mime = 'text/dns'").count() == 1
    assert spark.read.parquet(root).count() == full.count()
    with pytest.raises(store.SchemaMismatch, match="doi.gov.*ed.gov"):
        store.propagate_dns_all(full.withColumn("extra", F.lit(1)), root, TARGETS)
    assert spark.read.parquet(root).count() == full.count()


def test_key_ranges_let_a_host_filter_skip_files(spark, rows, tmp_path):
    """Ranges of keys do not overlap, and a host lies in few files, as the footers show."""
    keys = [f"gov,doi,h{k % 40:02d})/p{k:04d}" for k in range(4000)] + ["gov,ed)/hot"] * 1500
    df = rows("surtkey string, fetch_timestamp string, offset long", *[(k, f"{i:06d}", i) for i, k in enumerate(keys)])
    out = str(tmp_path / "ranges")
    assert store.split_by_domain(df.repartition(5), out, TARGETS, rows_per_file=500) == len(keys)
    spans = []
    for file in (tmp_path / "ranges").rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        column = [meta.schema.column(i).name for i in range(meta.num_columns)].index("surtkey")
        stats = [meta.row_group(g).column(column).statistics for g in range(meta.num_row_groups)]
        spans.append((min(x.min for x in stats), max(x.max for x in stats), file.parent.name, meta.num_rows))
    spans.sort()
    assert len(spans) >= 9 and max(n for *_, n in spans) < 1500
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    host = "gov,doi,h07)"
    assert sum(low[: len(host)] <= host <= high[: len(host)] for low, high, folder, _ in spans if "doi" in folder) <= 2
    hit = store.read_domain(spark, out, "doi.gov").where(F.col("surtkey").startswith(host))
    assert hit.count() == 100 and hit.select(F.input_file_name()).distinct().count() <= 2
    assert "StringStartsWith(surtkey,gov,doi,h07))" in hit._jdf.queryExecution().executedPlan().toString()


def test_split_into_many_files_takes_few_tasks(spark, rows, tmp_path):
    keys = [f"gov,doi,h{k % 40:02d})/p{k:04d}" for k in range(2400)] + ["gov,ed)/hot"] * 100
    df = rows("surtkey string, fetch_timestamp string, offset long", *[(k, f"{i:06d}", i) for i, k in enumerate(keys)])
    out = tmp_path / "many"
    assert store.split_by_domain(df.repartition(5), str(out), TARGETS, rows_per_file=10) == len(keys)
    files = [(f, pq.read_table(f)["surtkey"].to_pylist()) for f in out.rglob("*.parquet")]
    assert len(files) >= 250 and max(len(k) for _, k in files) <= 10
    assert len({re.match(r"part-(\d+)", f.name)[1] for f, _ in files}) <= 40
    spans = sorted((min(k), max(k)) for _, k in files)
    assert sum(len(k) for _, k in files) == len(keys) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))

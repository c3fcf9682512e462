"""Documents, tables, event files and the shared folder."""

import json
from types import SimpleNamespace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ratelake.operators import detect_changes, to_events
from ratelake.sources.documents import flatten_rates, parse_documents, read_documents
from ratelake.sources.event_files import write_events
from ratelake.sources.shared import shared_folder, staged
from ratelake.sources.tables import (
    drop_months,
    load,
    merge_into,
    months_of,
    note_pending,
    note_unpublished,
    pending_months,
    replace_months,
    stored_months,
    sweep_versions,
    unpublished,
    with_month,
)
from tests.test_operators import DAY, RUN_1, RUN_2, rates_frame, stored_frame

DOCUMENT = {
    "base": "USD",
    "rates": {"2026-05-06": {"MXN": 17.25, "EUR": 0.88}, "2026-05-07": {"MXN": 17}},
}
ROWS = {
    ("2026-05-06", "USD", "MXN", 17.25),
    ("2026-05-06", "USD", "EUR", 0.88),
    ("2026-05-07", "USD", "MXN", 17.0),
}


@pytest.fixture
def database(spark):
    name = shared_folder(spark, "test").rsplit("/", 1)[-1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def flat_rows(documents):
    return {(r.date, r.base, r.target, r.rate) for r in flatten_rates(documents, RUN_1).collect()}


def texts(spark, *values):
    return parse_documents(spark.createDataFrame([(value,) for value in values], "value string"))


def test_document_contract(spark):
    """The document is there, its base is USD, the start date and MXN are in it."""
    document = texts(spark, json.dumps(DOCUMENT)).collect()[0]
    assert document.base == "USD"
    assert "2026-05-06" in document.rates
    assert "MXN" in document.rates["2026-05-06"]


def test_flatten(spark):
    assert flat_rows(texts(spark, json.dumps(DOCUMENT))) == ROWS
    row = flatten_rates(texts(spark, json.dumps(DOCUMENT)), RUN_1).collect()[0]
    assert row.base_amount == 1.0 and row.ingested_at.day == 6


def test_flatten_edge_cases(spark):
    assert flat_rows(texts(spark, '{"rates": {}}', "{not json", "", "[]")) == set()
    no_base = texts(spark, '{"rates": {"2026-05-06": {"MXN": "17.25", "EUR": null, "BRL": "x"}}}')
    assert flat_rows(no_base) == {
        ("2026-05-06", "USD", "MXN", 17.25),
        ("2026-05-06", "USD", "EUR", None),
        ("2026-05-06", "USD", "BRL", None),
    }


def test_read_documents(spark, tmp_path):
    lines, pretty = tmp_path / "lines", tmp_path / "pretty"
    lines.mkdir(), pretty.mkdir()
    parts = [
        {"base": "USD", "rates": {day: values}} for day, values in DOCUMENT["rates"].items()
    ]
    (lines / "a.json").write_text("\n".join(json.dumps(part) for part in parts))
    (pretty / "a.json").write_text(json.dumps(DOCUMENT, indent=2))
    assert flat_rows(read_documents(spark, str(lines))) == ROWS
    assert flat_rows(read_documents(spark, str(pretty), one_per_file=True)) == ROWS


# --- tables


def simple(spark, *rows):
    return stored_frame(spark, [(day, target, rate, "INSERT") for day, target, rate in rows])


def values(df):
    return sorted((row.date, row.target, row.rate) for row in df.collect())


def test_append_creates_then_adds(spark, database):
    name = f"{database}.t"
    load(simple(spark, (DAY, "A", 1.0)), name)
    loaded, deletes = load(simple(spark, (DAY, "A", 1.0)).select("*"), name, "append")
    assert values(loaded) == [(DAY, "A", 1.0)] * 2 and not deletes
    assert loaded.columns[-2:] == ["year", "month"]


def test_append_matches_columns_by_name(spark, database):
    name = f"{database}.t"
    df = simple(spark, (DAY, "A", 1.0))
    load(df, name)
    loaded, _ = load(df.select(*reversed(df.columns)), name)
    assert values(loaded) == [(DAY, "A", 1.0)] * 2


def test_unknown_columns_are_refused(spark, database):
    df = simple(spark, (DAY, "A", 1.0))
    load(df, f"{database}.t")
    with pytest.raises(ValueError, match="extra"):
        load(df.withColumn("extra", F.lit(1)), f"{database}.t")


def test_overwrite_replaces_only_the_months_it_holds(spark, database):
    name = f"{database}.t"
    load(simple(spark, ("2026-04-01", "A", 1.0), ("2026-05-01", "A", 1.0)), name)
    loaded, _ = load(simple(spark, ("2026-05-02", "B", 2.0)), name, "overwrite_partitions")
    assert values(loaded) == [("2026-04-01", "A", 1.0), ("2026-05-02", "B", 2.0)]
    assert months_of(loaded) == [(2026, 4), (2026, 5)]
    drop_months(spark, name, [(2026, 4), (1999, 1)])
    assert values(spark.table(name)) == [("2026-05-02", "B", 2.0)]


def test_overwrite_of_an_unpartitioned_table_replaces_it(spark, database):
    name = f"{database}.t"
    load(simple(spark, ("2026-04-01", "A", 1.0)), name, partition_by=())
    loaded, _ = load(
        simple(spark, (DAY, "B", 2.0)), name, "overwrite_partitions", partition_by=()
    )
    assert values(loaded) == [(DAY, "B", 2.0)]


@pytest.mark.parametrize("partition_by", [("year", "month"), ()])
def test_merge_mode(spark, database, partition_by):
    name = f"{database}.t"
    stored, _ = load(
        simple(spark, ("2026-03-01", "A", 1.0), (DAY, "A", 1.0), (DAY, "B", 1.0)),
        name,
        "merge_cdc",
        partition_by=partition_by,
    )
    incoming = rates_frame(spark, [(DAY, "A", 2.0), ("2026-06-01", "C", 3.0)], RUN_2)
    changes = staged(detect_changes(incoming, stored, lo=DAY, hi="2026-12-31"), "changes")
    loaded, deletes = load(changes, name, "merge_cdc", partition_by=partition_by)
    assert deletes
    assert {(r.date, r.target): (r.rate, r.operation_type) for r in loaded.collect()} == {
        ("2026-03-01", "A"): (1.0, "INSERT"),
        (DAY, "A"): (2.0, "UPDATE"),
        (DAY, "B"): (1.0, "DELETE"),
        ("2026-06-01", "C"): (3.0, "INSERT"),
    }


def test_merge_refuses_rows_without_a_day(spark, database):
    load(simple(spark, (DAY, "A", 1.0)), f"{database}.t")
    changes = detect_changes(rates_frame(spark, [("2026-02-30", "A", 2.0)]))
    with pytest.raises(ValueError, match="ISO day"):
        load(changes, f"{database}.t", "merge_cdc")


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        load(simple(spark, (DAY, "A", 1.0)), "nowhere.t", "upsert")


def test_overwrite_mode_of_the_session_is_left_as_it_was(spark, database):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    name = f"{database}.t"
    load(simple(spark, (DAY, "A", 1.0)), name)
    load(simple(spark, (DAY, "A", 2.0)), name, "overwrite_partitions")
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_catalog_merge_needs_row_level_operations(spark, database):
    stored, _ = load(simple(spark, (DAY, "A", 1.0)), f"{database}.t")
    changes = detect_changes(rates_frame(spark, [(DAY, "A", 2.0)]), stored)
    with pytest.raises(PySparkException, match="does not support MERGE"):
        merge_into(changes, f"{database}.t", revive=True)


def test_pending_months(spark, database):
    name = f"{database}.t"
    load(simple(spark, (DAY, "A", 1.0)), name)
    assert pending_months(spark, name) == []
    months = [(2025, 11), (2025, 12), (2026, 1), (2026, 5), (1999, 12)]
    note_pending(spark, name, months)
    assert pending_months(spark, name) == sorted(months)
    note_pending(spark, name, [])
    assert pending_months(spark, name) == []


# --- files


def test_event_files(spark, tmp_path):
    incoming = rates_frame(spark, [(DAY, "A", 1.0), (DAY, "B", 2.0)])
    changes = detect_changes(incoming, None, run_ts=RUN_1)
    events = to_events(changes)
    path = str(tmp_path / "events")
    write_events(events, path)
    write_events(events.limit(0), path)
    write_events(events, path, files=1)
    lines = [json.loads(row.value) for row in spark.read.text(path).collect()]
    assert len(lines) == 4
    assert set(lines[0]) == {"event_type", "event_timestamp", "entity_id", "payload"}
    assert sorted(spark.read.schema(events.schema).json(path).collect()) == sorted(
        events.collect() * 2
    )


def test_staged_rows_come_from_files(spark):
    df = spark.range(10).select("id", F.rand().alias("x"))
    once = staged(df, "rows")
    assert once.collect() == once.collect() and once.count() == 10
    root = spark.conf.get("spark.checkpoint.dir")
    assert all(root in path for path in once.inputFiles())


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default=None: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_folder_is_the_one_of_the_session():
    assert shared_folder(session("yarn", "hdfs://x/shared/"), "a").startswith("hdfs://x/shared/a-")
    assert shared_folder(session("local[2]"), "a") != shared_folder(session("local[2]"), "a")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077"), "a")


def test_clean_takes_columns_without_an_order(spark):
    from ratelake.operators import clean_rates

    df = rates_frame(spark, [(DAY, "A", 2.0), (DAY, "A", 1.0)])
    df = df.withColumn("tags", F.array(F.create_map(F.lit("k"), "rate")))
    assert [row.rate for row in clean_rates(df).collect()] == [1.0]


def content(spark, name):
    return sorted((r.date, r.target, r.rate) for r in spark.table(name).collect())


def test_a_failure_before_the_swap_leaves_the_old_rows(spark, database, monkeypatch):
    """The new version is written, the catalog not yet told: every reader sees the old."""
    name = f"{database}.rates"
    load(simple(spark, ("2026-04-01", "A", 1.0), ("2026-05-01", "A", 2.0)), name)
    before = content(spark, name)

    def lost(*args):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr("ratelake.sources.tables._point_at", lost)
        with pytest.raises(RuntimeError):
            load(simple(spark, ("2026-05-01", "B", 3.0)), name, "overwrite_partitions")
    spark.catalog.refreshTable(name)
    assert content(spark, name) == before


def test_a_lost_driver_leaves_no_month_missing(spark, database, monkeypatch):
    """Lost between two swaps: one month is new, the other old, both are whole."""
    from ratelake.sources import tables

    name = f"{database}.rates"
    load(simple(spark, *[(f"2026-0{m}-0{d}", "A", 1.0) for m in (4, 5) for d in (1, 2)]), name)
    point_at, calls = tables._point_at, []

    def once(*args):
        if calls:
            raise RuntimeError("driver lost")
        calls.append(args)
        point_at(*args)

    new = simple(spark, *[(f"2026-0{m}-0{d}", "A", 2.0) for m in (4, 5) for d in (1, 2)])
    with monkeypatch.context() as patch:
        patch.setattr(tables, "_point_at", once)
        with pytest.raises(RuntimeError):
            load(new, name, "overwrite_partitions")
    spark.catalog.refreshTable(name)
    assert [rate for _, _, rate in content(spark, name)] == [2.0, 2.0, 1.0, 1.0]
    load(new, name, "overwrite_partitions")
    assert [rate for _, _, rate in content(spark, name)] == [2.0] * 4


def test_a_reader_that_has_begun_keeps_its_version(spark, database):
    name = f"{database}.rates"
    load(simple(spark, (DAY, "A", 1.0)), name)
    load(simple(spark, (DAY, "A", 2.0)), name, "overwrite_partitions")
    path = [file for file in spark.table(name).inputFiles()]
    assert all("_versions" in file for file in path)
    load(simple(spark, (DAY, "A", 3.0)), name, "overwrite_partitions")
    old = spark.read.parquet(*path)
    assert [row.rate for row in old.collect()] == [2.0]
    assert [rate for _, _, rate in content(spark, name)] == [3.0]


def test_sweep_removes_versions_that_nothing_points_at(spark, database):
    name = f"{database}.rates"
    load(simple(spark, ("2026-04-01", "A", 1.0), ("2026-05-01", "A", 1.0)), name)
    for rate in (2.0, 3.0):
        load(simple(spark, ("2026-05-01", "A", rate)), name, "overwrite_partitions")
    assert sweep_versions(spark, name, hours=1) == []
    assert len(sweep_versions(spark, name, hours=0)) == 1
    assert sweep_versions(spark, name, hours=0) == []
    assert content(spark, name) == [("2026-04-01", "A", 1.0), ("2026-05-01", "A", 3.0)]
    # Rows appended to a month go on in the version that it points at.
    load(simple(spark, ("2026-05-02", "A", 4.0)), name, "append")
    assert len(content(spark, name)) == 3


def test_replaced_months(spark, database):
    """New, replaced, emptied and undated months in one call; others stay."""
    name = f"{database}.rates"
    first = [("2026-03-01", "A", 1.0), ("2026-04-01", "A", 1.0), ("2026-05-01", "A", 1.0)]
    load(simple(spark, *first, ("no day", "A", 1.0)), name)
    rows = with_month(simple(spark, ("2026-04-02", "B", 2.0), ("2026-06-01", "B", 2.0), ("never", "B", 2.0)))
    assert replace_months(rows, name, [(2026, 4), (2026, 5)]) == [(2026, 4), (2026, 6)]
    assert stored_months(spark, name) == {(2026, 3), (2026, 4), (2026, 6), (None, None)}
    assert content(spark, name) == [
        ("2026-03-01", "A", 1.0),
        ("2026-04-02", "B", 2.0),
        ("2026-06-01", "B", 2.0),
        ("never", "B", 2.0),
    ]


def test_notes_hold_any_path(spark, database):
    name = f"{database}.rates"
    load(simple(spark, (DAY, "A", 1.0)), name)
    parts = {"events": ["s3://a,b/it's;=x", "s3://c\\d"], "quality": []}
    note_unpublished(spark, name, parts)
    assert unpublished(spark, name) == {"events": parts["events"]}


def test_events_of_a_batch_are_written_once(spark, tmp_path):
    events = to_events(detect_changes(rates_frame(spark, [(DAY, "A", 1.0)]), None, run_ts=RUN_1))
    path = str(tmp_path / "events")
    for batch in ("one", "one", "two"):
        write_events(events, path, batch=batch)
    found = spark.read.json(path)
    assert sorted(row.batch for row in found.collect()) == ["one", "two"]

"""Several batches over one set of tables."""

import json
import random
from datetime import date, timedelta

import pytest
from ratelake.operators import (
    detect_changes,
    fact_rates,
    flag_anomalies,
    live_rows,
    monthly_summary,
    rolling_metrics,
)
from ratelake.operators.metrics import calendar_month, chunk_tails
from ratelake.plans.batch import CELL, Tables, _by_month, affected_cells, rebuild, release, run_batch
from ratelake.schemas import CHANGES, CUSTOMERS, RATES, TRANSACTIONS
from ratelake.sources.documents import parse_documents, read_documents
from ratelake.sources.shared import shared_folder, staged, sweep_shared
from ratelake.sources.tables import load, pending_months, unpublished, with_month

RUNS = [f"2026-06-{day:02d} 00:00:00" for day in range(1, 29)]


@pytest.fixture
def tables(spark):
    name = shared_folder(spark, "batch").rsplit("/", 1)[-1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {name}")
    yield Tables.in_database(name)
    spark.sql(f"DROP DATABASE {name} CASCADE")


def documents(spark, rates):
    """{(date, currency): rate} as one document per date."""
    by_day: dict = {}
    for (day, target), rate in rates.items():
        by_day.setdefault(day, {})[target] = rate
    texts = [(json.dumps({"base": "USD", "rates": {d: r}}),) for d, r in by_day.items()]
    return parse_documents(spark.createDataFrame(texts or [('{"rates": {}}',)], "value string"))


def rows(df, *names):
    return sorted(tuple(row) for row in df.select(*names).collect())


def same_as_full_recompute(spark, tables):
    """The derived tables hold what all live rows give, and nothing else."""
    live = live_rows(spark.table(tables.base)).select(*CHANGES.fieldNames())
    metrics = ["date", "base", "target", "rate", "daily_variation_pct", "sma_7d", "sma_30d"]
    metrics += ["volatility_30d"]
    enriched = rolling_metrics(live)
    assert rows(spark.table(tables.enriched), *metrics) == rows(enriched, *metrics)
    flags = ["date", "base", "target", "is_anomaly", "z_score"]
    assert rows(spark.table(tables.anomalies), *flags) == rows(flag_anomalies(enriched), *flags)
    summary = monthly_summary(live)
    names = [name for name in summary.columns if name != "ingestion_timestamp"]
    assert rows(spark.table(tables.monthly), *names) == rows(summary, *names)
    tails = _by_month(chunk_tails(live, calendar_month()))
    assert rows(spark.table(tables.tails), *CELL, "tail") == rows(tails, *CELL, "tail")


def test_first_batch_then_no_change_then_update(spark, tables, tmp_path):
    rates = {("2026-05-06", "MXN"): 17.0, ("2026-05-07", "MXN"): 17.5, ("2026-05-06", "EUR"): 0.9}
    span = ("2026-05-06", "2026-05-08")
    events = str(tmp_path / "events")
    first = run_batch(
        documents(spark, rates), tables, *span, run_ts=RUNS[0], events_path=events
    )
    assert first.status == "complete" and not first.has_deletes
    assert spark.table(tables.base).count() == 3 and spark.read.json(events).count() == 3
    same_as_full_recompute(spark, tables)

    second = run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[1])
    assert second.status == "no_changes" and second.changes.isEmpty()

    rates["2026-05-07", "MXN"] *= 1.69
    third = run_batch(
        documents(spark, rates), tables, *span, run_ts=RUNS[2], events_path=events
    )
    assert third.status == "complete"
    assert rows(third.changes, "date", "target", "operation_type") == [
        ("2026-05-07", "MXN", "UPDATE")
    ]
    assert spark.read.json(events).count() == 4
    same_as_full_recompute(spark, tables)
    days = spark.table(tables.quality).groupBy("execution_timestamp").count().collect()
    assert sorted(row["count"] for row in days) == [2, 2]


def test_rows_outside_the_range_do_not_enter(spark, tables):
    rates = {("2026-05-05", "MXN"): 1.0, ("2026-05-06", "MXN"): 1.0, ("2026-05-09", "MXN"): 1.0}
    run_batch(documents(spark, rates), tables, "2026-05-06", "2026-05-08", run_ts=RUNS[0])
    assert rows(spark.table(tables.base), "date") == [("2026-05-06",)]


def test_empty_batch_is_all_deletes_and_stops(spark, tables):
    rates = {("2026-05-06", "MXN"): 17.0, ("2026-05-07", "MXN"): 17.5}
    span = ("2026-05-06", "2026-05-08")
    run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[0])
    stopped = run_batch(documents(spark, {}), tables, *span, run_ts=RUNS[1])
    assert (stopped.status, stopped.has_deletes) == ("base_only", True)
    assert rows(spark.table(tables.base), "operation_type") == [("DELETE",), ("DELETE",)]
    assert spark.table(tables.enriched).count() == 2
    # The latch: still absent, so a DELETE again; back at the same rate, still deleted.
    again = run_batch(documents(spark, {}), tables, *span, run_ts=RUNS[2])
    assert again.status == "base_only"
    back = run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[3])
    assert back.status == "no_changes"
    # That batch passed, so the derived tables now follow the deletes held back.
    same_as_full_recompute(spark, tables)
    assert spark.table(tables.enriched).isEmpty() and spark.table(tables.monthly).isEmpty()


def test_held_back_months_follow_with_the_next_batch(spark, tables):
    """The only May row of a pair goes in a held batch; its June frames must follow."""
    rates = {(f"2026-{month:02d}-15", "MXN"): float(month) for month in range(4, 9)}
    rates |= {("2026-05-15", "EUR"): 5.0, ("2026-06-15", "EUR"): 7.0}
    run_batch(documents(spark, rates), tables, "2026-04-01", "2026-08-31", run_ts=RUNS[0])
    may = {key: rate for key, rate in rates.items() if key == ("2026-05-15", "MXN")}
    span = ("2026-05-01", "2026-05-31")
    assert run_batch(documents(spark, may), tables, *span, run_ts=RUNS[1]).status == "base_only"
    assert pending_months(spark, tables.base) == [(2026, 5)]
    assert spark.table(tables.enriched).count() == 7
    august = {("2026-08-15", "MXN"): 80.0}
    span = ("2026-08-01", "2026-08-31")
    assert run_batch(documents(spark, august), tables, *span, run_ts=RUNS[2]).status == "complete"
    assert pending_months(spark, tables.base) == []
    same_as_full_recompute(spark, tables)


def test_a_failed_batch_is_caught_up(spark, tables, monkeypatch):
    rates = {(f"2026-05-{day:02d}", "MXN"): float(day) for day in range(1, 8)}
    span = ("2026-05-01", "2026-05-31")
    run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[0])
    rates["2026-05-03", "MXN"] = 30.0

    def lost(*args, **options):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patched:
        patched.setattr("ratelake.plans.batch.rolling_metrics", lost)
        with pytest.raises(RuntimeError):
            run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[1])
    again = run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[2])
    assert again.status == "no_changes"
    same_as_full_recompute(spark, tables)


def test_rebuild(spark, tables):
    rates = {("2026-05-06", "MXN"): 17.0, ("2026-06-07", "MXN"): 17.5}
    run_batch(documents(spark, rates), tables, "2026-05-01", "2026-06-30", run_ts=RUNS[0])
    run_batch(documents(spark, {}), tables, "2026-06-01", "2026-06-30", run_ts=RUNS[1])
    rebuild(spark, tables, RUNS[2])
    assert pending_months(spark, tables.base) == []
    same_as_full_recompute(spark, tables)
    assert rows(spark.table(tables.enriched), "date") == [("2026-05-06",)]


def test_strict_tombstones_come_back(spark, tables):
    rates = {("2026-05-06", "MXN"): 17.0, ("2026-05-07", "MXN"): 17.5}
    span = ("2026-05-06", "2026-05-08")
    options = {"tombstones": "strict", "on_delete": "continue"}
    run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[0], **options)
    run_batch(documents(spark, {}), tables, *span, run_ts=RUNS[1], **options)
    assert spark.table(tables.enriched).isEmpty()
    quiet = run_batch(documents(spark, {}), tables, *span, run_ts=RUNS[2], **options)
    assert quiet.status == "no_changes"
    run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[3], **options)
    assert rows(spark.table(tables.base), "rate", "operation_type") == [
        (17.0, "INSERT"),
        (17.5, "INSERT"),
    ]
    same_as_full_recompute(spark, tables)


def test_nothing_readable_deletes_nothing(spark, tables):
    rates = {("2026-05-06", "MXN"): 17.0}
    span = ("2026-05-06", "2026-05-08")
    run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[0])
    broken = parse_documents(spark.createDataFrame([("<html>",)], "value string"))
    assert run_batch(broken, tables, *span, run_ts=RUNS[1]).status == "rejected"
    for nothing in (broken, broken.limit(0)):
        batch = run_batch(nothing, tables, *span, run_ts=RUNS[1], on_reject="skip")
        assert batch.status == "no_documents"
    assert rows(spark.table(tables.base), "operation_type") == [("INSERT",)]


BAD_DAYS = {
    "number": '{"MXN": "n/a", "EUR": 0.9}',
    "null": '{"MXN": null, "EUR": 0.9}',
    "empty day": "null",
    "truncated": '{"MXN": 17.',
}


@pytest.mark.parametrize("fault", sorted(BAD_DAYS))
@pytest.mark.parametrize("on_reject", ["refuse", "skip"])
def test_bad_input_deletes_nothing_and_heals(spark, tables, fault, on_reject):
    day, span = "2026-05-06", ("2026-05-06", "2026-05-08")
    good = {(day, "MXN"): 17.0, (day, "EUR"): 0.9, ("2026-05-07", "MXN"): 17.1}
    run_batch(documents(spark, good), tables, *span, run_ts=RUNS[0])
    before = rows(spark.table(tables.base), "date", "target", "rate", "operation_type")
    texts = [
        ('{"base": "USD", "rates": {"%s": %s}}' % (day, BAD_DAYS[fault]),),
        ('{"base": "USD", "rates": {"2026-05-07": {"MXN": 17.1}}}',),
    ]
    bad = parse_documents(spark.createDataFrame(texts, "value string"))
    batch = run_batch(bad, tables, *span, run_ts=RUNS[1], on_reject=on_reject)
    assert batch.status == ("rejected" if on_reject == "refuse" else "no_changes")
    assert batch.rejects.count() == 1
    assert rows(spark.table(tables.base), "date", "target", "rate", "operation_type") == before
    repaired = run_batch(documents(spark, good), tables, *span, run_ts=RUNS[2])
    assert repaired.status == "no_changes"
    same_as_full_recompute(spark, tables)


def test_skipping_still_deletes_what_is_surely_gone(spark, tables):
    day, span = "2026-05-06", ("2026-05-06", "2026-05-08")
    good = {(day, "MXN"): 17.0, (day, "EUR"): 0.9}
    run_batch(documents(spark, good), tables, *span, run_ts=RUNS[0])
    bad = documents(spark, {(day, "MXN"): "n/a"})
    batch = run_batch(bad, tables, *span, run_ts=RUNS[1], on_reject="skip")
    assert batch.status == "base_only"
    assert rows(spark.table(tables.base), "target", "operation_type") == [
        ("EUR", "DELETE"),
        ("MXN", "INSERT"),
    ]


def test_the_newest_document_wins(spark, tables, tmp_path):
    import os

    for name, rate, at in (("b", 17.0, 1000), ("a", 19.0, 2000)):
        file = tmp_path / f"{name}.json"
        file.write_text(json.dumps({"rates": {"2026-05-06": {"MXN": rate}}}))
        os.utime(file, (at, at))
    landed = read_documents(spark, str(tmp_path))
    run_batch(landed, tables, "2026-05-06", "2026-05-06", run_ts=RUNS[0])
    assert rows(spark.table(tables.base), "rate") == [(19.0,)]


STEPS = ["rolling_metrics", "monthly_summary", "flag_anomalies", "coverage_report", "write_events"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("first", [True, False])
def test_a_failure_at_any_step_is_caught_up(spark, tables, tmp_path, monkeypatch, step, first):
    span, events = ("2026-05-01", "2026-05-31"), str(tmp_path / "events")
    old, new = {("2026-05-06", "MXN"): 17.0}, {("2026-05-06", "MXN"): 17.0, ("2026-05-07", "MXN"): 18.0}
    if not first:
        run_batch(documents(spark, old), tables, *span, run_ts=RUNS[0], events_path=events)

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(f"ratelake.plans.batch.{step}", fail)
        with pytest.raises(RuntimeError):
            run_batch(documents(spark, new), tables, *span, run_ts=RUNS[1], events_path=events)
    batch = run_batch(documents(spark, new), tables, *span, run_ts=RUNS[2], events_path=events)
    assert batch.status == "no_changes"
    same_as_full_recompute(spark, tables)
    assert spark.table(tables.quality).count() == (2 if first else 3)
    assert spark.read.json(events).count() == 2
    again = run_batch(documents(spark, new), tables, *span, run_ts=RUNS[3], events_path=events)
    assert again.status == "no_changes" and spark.read.json(events).count() == 2


@pytest.mark.parametrize("kind", ["quality", "events"])
def test_a_failure_after_the_write_publishes_once(spark, tables, tmp_path, monkeypatch, kind):
    """The rows are written, the note is not taken back: they are not written twice."""
    from ratelake.plans import batch as module

    span, events = ("2026-05-01", "2026-05-31"), str(tmp_path / "events")
    rates = {("2026-05-06", "MXN"): 17.0, ("2026-05-08", "MXN"): 18.0}
    note = module.note_unpublished

    def lost(spark, table, left):
        if not left.get(kind, ["still noted"]):
            raise RuntimeError("driver lost")
        note(spark, table, left)

    with monkeypatch.context() as patch:
        patch.setattr(module, "note_unpublished", lost)
        with pytest.raises(RuntimeError):
            run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[0], events_path=events)
    run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[1], events_path=events)
    assert rows(spark.table(tables.quality), "dq_date", "is_missing") == [
        (date(2026, 5, 6), False),
        (date(2026, 5, 7), True),
        (date(2026, 5, 8), False),
    ]
    assert rows(spark.read.json(events), "entity_id") == [
        ("USD-MXN-2026-05-06",),
        ("USD-MXN-2026-05-08",),
    ]


def test_an_increment_reads_its_own_pair_alone(spark, tables, monkeypatch):
    """One changed row of a sparse pair among 2,000 dense ones: of the base table no month
    before the change is read, of its months' pages only those of the pair, and no row of
    another pair gets past the scan."""
    from ratelake.plans import batch as module

    months = [(2025, m) for m in range(1, 4)] + [(2026, 1)]
    dense = [
        (f"{y}-{m:02d}-{d:02d}", 1.0, "USD", f"P{p:04d}", 1.0 + p, None)
        for y, m in months
        for p in range(2000)
        for d in range(1, 9)
    ]
    sparse = [(f"{y}-{m:02d}-15", 1.0, "USD", "P0500x", 5.0, None) for y, m in months]
    frame = spark.createDataFrame(dense + sparse, RATES)
    load(detect_changes(frame, None, run_ts=RUNS[0]), tables.base)
    rebuild(spark, tables, RUNS[0])
    changed = spark.createDataFrame([("2025-03-15", 1.0, "USD", "P0500x", 6.0, None)], RATES)
    stored = spark.table(tables.base)
    changes = staged(
        with_month(detect_changes(changed, stored.filter("target = 'P0500x'"), lo="2025-03-15", hi="2025-03-15")),
        "changes",
    )
    load(changes, tables.base, "merge_cdc")
    taken = []
    next_tails = module.next_tails

    def watched(rows, cells, reach):
        taken.append(rows)
        return next_tails(rows, cells, reach)

    monkeypatch.setattr(module, "next_tails", watched)
    module._refresh(spark, tables, changes, [(2025, 3)], [], RUNS[1])
    (history,) = taken
    assert rows(history, "date", "target", "rate") == [
        ("2025-03-15", "P0500x", 6.0),
        ("2026-01-15", "P0500x", 5.0),
    ]
    read = scanned_rows(history, "rate")
    assert 2 <= read <= 2 * 8000 < 2 * 16001, "of two months, the pages of the pair"
    same_as_full_recompute(spark, tables)


def scanned_rows(df, column):
    """Rows that the scans of a plan gave out that read ``column``."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec" and f"{column}#" in node.output().toString():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_staged_folders_have_an_end(spark, tables, tmp_path, monkeypatch):
    """A batch leaves what its result reads and what notes name; release leaves the latter."""
    monkeypatch.setattr("ratelake.sources.shared.shared_root", lambda _: str(tmp_path / "shared"))
    span, events = ("2026-05-01", "2026-05-31"), str(tmp_path / "events")
    rates = {("2026-05-06", "MXN"): 17.0, ("2026-05-08", "MXN"): 18.0}

    def kinds():
        return sorted(path.name.rsplit("-", 1)[0] for path in (tmp_path / "shared").iterdir())

    batch = run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[0], events_path=events)
    assert kinds() == ["changes", "flattened"] and batch.changes.count() == 2
    release(spark, tables, batch)
    assert kinds() == []
    rates["2026-05-06", "MXN"] = 19.0

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("ratelake.plans.batch.rolling_metrics", fail)
        with pytest.raises(RuntimeError):
            run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[1], events_path=events)
    noted = [path for paths in unpublished(spark, tables.base).values() for path in paths]
    left = len(kinds())
    assert len(noted) == 2 and left > 2
    assert sweep_shared(spark, hours=1, keep=noted) == []
    (tmp_path / "shared" / "of-another").mkdir()
    assert len(sweep_shared(spark, hours=0, keep=noted)) == left - 2
    assert kinds() == ["changes", "incoming", "of"]
    release(spark, tables, run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[2], events_path=events))
    assert spark.read.json(events).count() == 3
    same_as_full_recompute(spark, tables)


def test_a_set_of_tables_keeps_its_scope(spark, tables):
    span = ("2026-05-01", "2026-06-30")
    rates = {("2026-05-06", "MXN"): 17.0, ("2026-06-06", "MXN"): 18.0}
    run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[0], scope="changes")
    before = rows(spark.table(tables.monthly), "year", "month")
    more = rates | {("2026-06-07", "MXN"): 18.5}
    with pytest.raises(ValueError, match="scope"):
        run_batch(documents(spark, more), tables, *span, run_ts=RUNS[1])
    assert rows(spark.table(tables.monthly), "year", "month") == before
    assert spark.table(tables.base).count() == 2


def test_report_and_options(spark, tables):
    rates = {("2026-05-08", "BRL"): 5.0, ("2026-05-08", "EUR"): 0.88}
    transactions = spark.createDataFrame(
        [("T1", "2026-05-08", "C1", "BRL", 250.0), ("T2", "2026-05-08", "C2", "EUR", 15.5)],
        TRANSACTIONS,
    )
    customers = spark.createDataFrame(
        [("C1", "One", "Premium"), ("C2", "Two", "Standard")], CUSTOMERS
    )
    batch = run_batch(
        documents(spark, rates),
        tables,
        "2026-05-06",
        "2026-05-08",
        run_ts=RUNS[0],
        transactions=transactions,
        customers=customers,
    )
    assert rows(batch.report, "transaction_id", "amount_in_usd") == [("T1", 50.0), ("T2", 17.61)]
    assert batch.rates.columns == fact_rates(batch.changes).columns
    for option in ({"on_delete": "maybe"}, {"scope": "all"}):
        with pytest.raises(ValueError):
            run_batch(documents(spark, rates), tables, "2026-05-06", "2026-05-08", **option)


def test_scope_of_changes(spark, tables):
    """Metrics over the change rows alone; enriched and monthly replaced, anomalies appended."""
    rates = {(f"2026-05-{day:02d}", "MXN"): float(day) for day in range(1, 11)}
    span = ("2026-05-01", "2026-05-31")
    run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[0], scope="changes")
    assert spark.table(tables.enriched).count() == 10
    rates["2026-05-04", "MXN"] = 40.0
    rates["2026-05-08", "MXN"] = 80.0
    run_batch(documents(spark, rates), tables, *span, run_ts=RUNS[1], scope="changes")
    assert rows(spark.table(tables.enriched), "date", "sma_7d", "daily_variation_pct") == [
        ("2026-05-04", 40.0, 0.0),
        ("2026-05-08", 60.0, 100.0),
    ]
    assert rows(spark.table(tables.monthly), "observations_count") == [(2,)]
    assert spark.table(tables.anomalies).count() == 12


def test_digests_find_the_same_changes(spark, tables, monkeypatch):
    """Whole and part months, tombstones, a month that goes, a failure before the digests
    follow: each batch finds what comparing every row finds."""
    from ratelake.plans import batch as module

    state = {
        (f"2026-{m:02d}-{d:02d}", pair): float(m * d) for m in range(1, 7) for d in (3, 9, 27) for pair in "AB"
    }
    span = ("2026-01-01", "2026-06-30")
    options = {"on_delete": "continue", "compare": "digests"}
    read = []
    by_digest = module.detect_changes_by_digest

    def watched(new, target, cells, months, **kwargs):
        read.append((sorted(map(tuple, cells.collect())), months))
        return by_digest(new, target, cells, months, **kwargs)

    monkeypatch.setattr(module, "detect_changes_by_digest", watched)

    def step(run, lo, hi, **more):
        stored = spark.table(tables.base)
        batch = {key: rate for key, rate in state.items() if lo <= key[0] <= hi}
        kwargs = {"lo": lo, "hi": hi, "tombstones": more.get("tombstones", "latched")}
        incoming = spark.createDataFrame(
            [(d, 1.0, "USD", t, r, None) for (d, t), r in batch.items()], RATES
        )
        names = ("date", "target", "rate", "operation_type")
        want = rows(detect_changes(incoming, stored, **kwargs), *names)
        found = run_batch(documents(spark, batch), tables, lo, hi, run_ts=RUNS[run], **options, **more)
        assert rows(found.changes, *names) == want
        return want

    run_batch(documents(spark, state), tables, *span, run_ts=RUNS[0], **options)
    assert step(1, *span) == [] and read[-1] == ([], [])
    state["2026-03-09", "A"] = 99.0
    assert len(step(2, *span)) == 1
    assert read[-1] == ([("USD", "A", 2026, 3)], [(2026, 3)])
    same_as_full_recompute(spark, tables)
    # Months that the range covers in part are compared row by row.
    del state["2026-02-27", "B"]
    assert len(step(3, "2026-02-20", "2026-04-05")) == 1
    assert {cell[3] for cell in read[-1][0]} == {2, 4}
    # Gone and latched: absent rows are a DELETE again, with strict tombstones they are not.
    assert len(step(4, *span)) == 1 and step(5, *span, tombstones="strict") == []
    for key in [key for key in state if key[0].startswith("2026-05") and key[1] == "B"]:
        del state[key]
    assert len(step(6, *span, tombstones="strict")) == 3
    state["2026-06-03", "B"] = 7.5

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(module, "_refresh_digests", lost)
        with pytest.raises(RuntimeError):
            run_batch(documents(spark, state), tables, *span, run_ts=RUNS[7], tombstones="strict", **options)
    state["2026-06-03", "B"] = 18.0  # as before the lost batch, whose digest it still is
    assert len(step(8, *span, tombstones="strict")) == 1
    assert step(9, *span, tombstones="strict") == []
    same_as_full_recompute(spark, tables)


@pytest.mark.parametrize("seed", [3, 4])
def test_incremental_equals_full_recompute(spark, tables, seed):
    """Random histories with dense, sparse and interrupted pairs, changed at random."""
    draw = random.Random(seed)
    first = date(2024, 11, 1)
    days = [(first + timedelta(days=i)).isoformat() for i in range(485)]
    share = {"DENSE": 0.9, "WEEKLY": 0.14, "RARE": 0.02, "BREAK": 0.6}
    state = {
        (day, target): round(draw.uniform(1, 2), 3)
        for day in days
        for target in share
        if draw.random() < share[target] and not (target == "BREAK" and "2025-03" < day < "2025-11")
    }
    span = (days[0], days[-1])
    options = {"on_delete": "continue", "tombstones": "strict"}
    options["compare"] = "digests" if seed == 4 else "rows"
    run_batch(documents(spark, state), tables, *span, run_ts=RUNS[0], **options)
    for step in range(1, 3):
        start = draw.randrange(len(days) - 40)
        lo, hi = days[start], days[start + 40]
        inside = [key for key in state if lo <= key[0] <= hi]
        for key in draw.sample(inside, min(5, len(inside))):
            if draw.random() < 0.5:
                del state[key]
            else:
                state[key] = round(draw.uniform(1, 2), 3)
        state[draw.choice([day for day in days if lo <= day <= hi]), "NEW"] = 1.5
        batch = {key: rate for key, rate in state.items() if lo <= key[0] <= hi}
        run_batch(documents(spark, batch), tables, lo, hi, run_ts=RUNS[step], **options)
        live = live_rows(spark.table(tables.base))
        assert rows(live, "date", "target", "rate") == sorted(
            (day, target, rate) for (day, target), rate in state.items()
        )
        same_as_full_recompute(spark, tables)


def test_cells_in_reach(spark):
    """20 rows a month: 29 rows reach one month and a part of the next, of the pair alone."""
    cell = "base string, target string, year int, month int"
    counts = spark.createDataFrame(
        [("USD", "A", 2026, month, 20) for month in range(1, 13)]
        + [("USD", "B", 2026, month, 1) for month in (1, 12)],
        f"{cell}, n long",
    )
    tails = counts.drop("n").selectExpr(
        "*", "array(named_struct('date', concat('before ', month), 'rate', 1d)) as tail"
    )
    touched = spark.createDataFrame([("USD", "A", 2026, 5), ("USD", "A", 2026, 11)], cell)
    found = affected_cells(counts, touched, tails, 29)
    assert rows(found, "target", "month", "affected", "stretch") == [
        ("A", 5, True, 1),
        ("A", 6, True, 1),
        ("A", 7, True, 1),
        ("A", 11, True, 2),
        ("A", 12, True, 2),
    ]
    assert rows(found, "month", "tail.date")[0] == (5, ["before 5"])
    # A month without a tail takes the month before it along, and that month's tail.
    touched = spark.createDataFrame([("USD", "A", 2026, 5)], cell)
    found = affected_cells(counts, touched, tails.filter("target <> 'A' or month <> 5"), 29)
    assert rows(found, "month", "affected", "tail.date") == [
        (4, False, ["before 4"]),
        (5, True, ["before 4"]),
        (6, True, ["before 4"]),
        (7, True, ["before 4"]),
    ]
    # The sparse pair: its December is reached from January, eleven months before.
    touched = spark.createDataFrame([("USD", "B", 2026, 1)], cell)
    assert rows(affected_cells(counts, touched, tails, 29), "target", "month") == [
        ("B", 1),
        ("B", 12),
    ]

"""One batch: documents -> changes -> base table -> derived tables and events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelake.functions.columns import month_number
from ratelake.operators import (
    clean_rates,
    convert_transactions,
    coverage_report,
    detect_changes,
    fact_rates,
    flag_anomalies,
    in_range,
    live_rows,
    monthly_summary,
    rolling_metrics,
    to_events,
    valid_days,
)
from ratelake.operators.digests import (
    CELL,
    detect_changes_by_digest,
    differing_cells,
    stored_digests,
)
from ratelake.operators.metrics import LONG_FRAME, calendar_month, chunk_tails, last_of
from ratelake.schemas import CHANGES, DELETE, KEYS, PAIR, RATES
from ratelake.sources.documents import (
    DEFAULT_BASE,
    EMPTY_DAY,
    ORIGIN,
    UNREADABLE,
    flatten_documents,
    rejected,
)
from ratelake.sources.event_files import write_events
from ratelake.sources.shared import remove_folders, staged, staged_at, tracking
from ratelake.sources.tables import (
    DIGESTS,
    Month,
    in_months,
    keep_scope,
    load,
    months_of,
    note_pending,
    note_unpublished,
    pending_months,
    replace_months,
    stored_months,
    touched_months,
    unpublished,
    with_month,
)

#: Touched pairs up to which their names are given to the scans.
MOST_PAIRS = 1000


@dataclass(frozen=True)
class Tables:
    """Names of the stored tables.

    ``tails`` holds, for each pair and month, the rows before it that its first frames
    reach back to, so that one month of one pair can be computed from itself. ``digests``
    holds those of the base table's months, once a batch has asked for them.
    """

    base: str
    enriched: str
    monthly: str
    anomalies: str
    quality: str
    tails: str = ""
    digests: str = ""

    def __post_init__(self):
        for name, default in (("tails", self.enriched), ("digests", self.base)):
            if not getattr(self, name):
                object.__setattr__(self, name, f"{default}_{name}")

    @classmethod
    def in_database(cls, database: str) -> Tables:
        return cls(
            base=f"{database}.exchange_rates",
            enriched=f"{database}.exchange_rates_enriched",
            monthly=f"{database}.monthly_metrics",
            anomalies=f"{database}.anomalies",
            quality=f"{database}.quality_report",
        )

    def derived(self) -> tuple[str, ...]:
        return (self.enriched, self.monthly, self.anomalies, self.tails)


@dataclass(frozen=True)
class Batch:
    """What a run did.

    ``status``: "rejected" (the input has values or documents that cannot be used; no
    table was touched), "no_documents" (nothing came in), "no_changes", "base_only"
    (stopped at a DELETE) or "complete". ``rejects`` holds what cannot be used.
    ``rates`` and ``report`` cover the batch's date range. ``folders``: the staged folders
    that these DataFrames read; :func:`release` removes them.
    """

    status: str
    changes: DataFrame | None = None
    has_deletes: bool = False
    rates: DataFrame | None = None
    report: DataFrame | None = None
    rejects: DataFrame | None = None
    folders: tuple[str, ...] = ()


def run_batch(
    documents: DataFrame,
    tables: Tables,
    lo: str,
    hi: str,
    *,
    run_ts: datetime | str | None = None,
    on_delete: str = "stop",
    tombstones: str = "latched",
    scope: str = "history",
    on_reject: str = "refuse",
    tie_break: Sequence[str] | None = None,
    base: str = DEFAULT_BASE,
    transactions: DataFrame | None = None,
    customers: DataFrame | None = None,
    events_path: str | None = None,
    compare: str = "rows",
) -> Batch:
    """Bring the tables up to date with the documents of one date range.

    ``on_delete="stop"``: a batch with a DELETE updates the base table and nothing
    else. ``"continue"`` goes on. The months held back, by a stop or a failure, stay
    noted on the base table, and the next batch that passes brings them up to date.

    ``on_reject="refuse"``: a bad value, an empty day or an unreadable document stops
    the batch before it touches a table. ``"skip"`` goes on without them, and deletes
    nothing that they may have held: no key with a bad value, no key of an empty day,
    and nothing at all if a document is unreadable.

    ``tie_break``: which of several values for one key counts (see ``clean_rates``); by
    default that of the newest file. ``base``: the base of the transaction report.

    ``scope="history"``: metrics see the live rows before each date, and only the
    months of a pair that its own changes reach are computed again. ``scope="changes"``: metrics
    see the change rows alone, the enriched and monthly tables are replaced as a
    whole, and anomalies are appended. A set of tables keeps to one scope; another one
    is refused.

    ``compare="rows"`` compares every row of the range with the stored one. ``"digests"``
    keeps digests of each pair's months beside the base table and reads only months that
    differ, at the risk of a collision of two 64-bit hash sums.

    A batch that fails half way leaves notes on the base table. The next one, also one
    without changes, brings the derived tables up to date and publishes the quality rows
    and events that were left out. One writer at a time: the notes are not locked.

    The driver handles one small result, the changed months: at most twelve rows for
    each calendar year between ``lo`` and ``hi``.

    Staged folders that neither the result nor a note needs are removed at the end; what a
    failed batch leaves is for ``sweep_shared``.
    """
    spark = documents.sparkSession
    with tracking() as folders:
        batch = _run_batch(
            documents,
            tables,
            lo,
            hi,
            run_ts=run_ts,
            on_delete=on_delete,
            tombstones=tombstones,
            scope=scope,
            on_reject=on_reject,
            tie_break=tie_break,
            base=base,
            transactions=transactions,
            customers=customers,
            events_path=events_path,
            compare=compare,
        )
    mine = [path for path in folders if _batch_of(path).rsplit("-", 1)[0] in _READ_BY_RESULT]
    remove_folders(spark, folders, keep=[*mine, *_noted_folders(spark, tables)])
    return replace(batch, folders=tuple(mine))


#: Staged folders that the DataFrames of a result read.
_READ_BY_RESULT = ("flattened", "changes")


def release(spark: SparkSession, tables: Tables, batch: Batch) -> None:
    """Remove the staged folders of a batch whose DataFrames are not needed any more, but
    for those that still are to be published."""
    remove_folders(spark, batch.folders, keep=_noted_folders(spark, tables))


def _noted_folders(spark: SparkSession, tables: Tables) -> list[str]:
    """The staged folders that the next batch publishes from."""
    if not spark.catalog.tableExists(tables.base):
        return []
    return [path for paths in unpublished(spark, tables.base).values() for path in paths]


def _run_batch(
    documents: DataFrame,
    tables: Tables,
    lo: str,
    hi: str,
    *,
    run_ts: datetime | str | None,
    on_delete: str,
    tombstones: str,
    scope: str,
    on_reject: str,
    tie_break: Sequence[str] | None,
    base: str,
    transactions: DataFrame | None,
    customers: DataFrame | None,
    events_path: str | None,
    compare: str,
) -> Batch:
    if on_delete not in ("stop", "continue"):
        raise ValueError(f"on_delete must be 'stop' or 'continue', not {on_delete!r}")
    if scope not in ("history", "changes"):
        raise ValueError(f"scope must be 'history' or 'changes', not {scope!r}")
    if on_reject not in ("refuse", "skip"):
        raise ValueError(f"on_reject must be 'refuse' or 'skip', not {on_reject!r}")
    if compare not in ("rows", "digests"):
        raise ValueError(f"compare must be 'rows' or 'digests', not {compare!r}")
    spark = documents.sparkSession
    exists = spark.catalog.tableExists(tables.base)
    if exists:
        keep_scope(spark, tables.base, scope)
    run_ts = datetime.now().astimezone() if run_ts is None else run_ts

    # Parsed once, for the rejects, the changes and the coverage report.
    flat = staged(flatten_documents(documents, run_ts), "flattened")
    rejects = rejected(flat)
    damaged = not rejects.isEmpty()
    if damaged and on_reject == "refuse":
        return Batch("rejected", rejects=rejects)
    if tie_break is None:
        tie_break = [f"-{name}" for name in ORIGIN if name in flat.columns]
    good = flat.filter(F.col("problem").isNull()).drop("problem", "value_text")
    cleaned = valid_days(clean_rates(good, tie_break=tie_break)).select(*RATES.fieldNames())
    incoming, incoming_path = staged_at(in_range(cleaned, lo, hi), "incoming")
    if incoming.isEmpty() and documents.filter(F.col("rates").isNotNull()).isEmpty():
        # Nothing came in at all. That is no reason to delete what is stored.
        return Batch("no_documents", rejects=rejects)
    stored = spark.table(tables.base) if exists else None
    options = {"lo": lo, "hi": hi, "run_ts": run_ts, "tombstones": tombstones}
    if exists and compare == "digests" and spark.catalog.tableExists(tables.digests):
        found = _differing(spark, tables, incoming, options)
    else:
        found = detect_changes(incoming, stored, **options)
    if damaged:
        found = _without_doubtful_deletes(found, rejects)
    # The plan of the changes reads the table that the merge rewrites.
    changes, changes_path = staged_at(with_month(found), "changes")
    months, deletes = touched_months(changes)
    pending = pending_months(spark, tables.base) if exists else []
    if exists and scope == "history" and not months:
        behind = not all(spark.catalog.tableExists(name) for name in tables.derived())
        if pending or behind:
            _refresh(spark, tables, changes, months, pending, run_ts)
    if exists and not months:
        _publish(spark, tables, events_path, run_ts)
    if not months:
        return Batch("no_changes", changes, rejects=rejects)

    if not exists:
        # An empty table first, so that the notes are there before the rows are.
        load(changes.limit(0), tables.base, "append")
        keep_scope(spark, tables.base, scope)
    left = unpublished(spark, tables.base)
    if scope == "history":
        note_pending(spark, tables.base, {*months, *pending})
    if not (deletes and on_delete == "stop"):
        left.setdefault("quality", []).append(incoming_path)
        if events_path is not None:
            left.setdefault("events", []).append(changes_path)
        note_unpublished(spark, tables.base, left)
    keeps_digests = compare == "digests" or spark.catalog.tableExists(tables.digests)
    if keeps_digests:
        # Until the digests follow, these months are compared row by row.
        doubt = {*months, *pending_months(spark, tables.base, DIGESTS)}
        note_pending(spark, tables.base, doubt, DIGESTS)
    load(changes, tables.base, "merge_cdc", revive=tombstones == "strict")
    if keeps_digests:
        _refresh_digests(spark, tables, changes, sorted(doubt))
    if deletes and on_delete == "stop":
        return Batch("base_only", changes, has_deletes=True, rejects=rejects)

    if scope == "changes":
        enriched = rolling_metrics(changes.select(*CHANGES.fieldNames()), run_ts=run_ts)
        load(enriched, tables.enriched, "overwrite_partitions", partition_by=())
        monthly = monthly_summary(changes, run_ts=run_ts)
        load(monthly, tables.monthly, "overwrite_partitions", partition_by=())
        load(flag_anomalies(enriched), tables.anomalies, "append")
        current = changes
    else:
        _refresh(spark, tables, changes, months, pending, run_ts)
        current = spark.table(tables.base)

    _publish(spark, tables, events_path, run_ts)
    rates = fact_rates(in_range(current, lo, hi))
    report = None
    if transactions is not None and customers is not None:
        report = convert_transactions(transactions, customers, rates, base=base)
    return Batch(
        "complete", changes, has_deletes=deletes, rates=rates, report=report, rejects=rejects
    )


def _differing(spark: SparkSession, tables: Tables, incoming: DataFrame, options: dict) -> DataFrame:
    """The changes, from the months of pairs whose digests differ."""
    lo, hi = options["lo"], options["hi"]
    doubt = pending_months(spark, tables.base, DIGESTS)
    new = with_month(incoming)
    cells = differing_cells(
        new, spark.table(tables.digests), lo, hi, options["tombstones"], in_doubt=doubt
    )
    cells = staged(cells, "differing")
    return detect_changes_by_digest(new, spark.table(tables.base), cells, months_of(cells), **options)


def _refresh_digests(
    spark: SparkSession, tables: Tables, changes: DataFrame, months: list[Month]
) -> None:
    """Bring the digests of the changed months up to date, and of those left in doubt."""
    base = spark.table(tables.base)
    if not spark.catalog.tableExists(tables.digests):
        load(stored_digests(base), tables.digests, "append")
    else:
        left = pending_months(spark, tables.base, DIGESTS)
        cells = changes.select(*CELL).unionByName(in_months(base, left).select(*CELL)).distinct()
        cells = staged(cells, "touched")
        rows = in_months(base, months).join(cells, [*CELL], "left_semi")
        _replace_cells(stored_digests(rows), tables.digests, cells, months)
    note_pending(spark, tables.base, [], DIGESTS)


def _without_doubtful_deletes(changes: DataFrame, rejects: DataFrame) -> DataFrame:
    """The changes without DELETEs of keys that the rejected input may have held."""
    if not rejects.filter(F.col("problem") == UNREADABLE).isEmpty():
        return changes.filter(F.col("operation_type") != DELETE)
    days = rejects.filter(F.col("problem") == EMPTY_DAY).select("date", "base").distinct()
    keys = rejects.filter(F.col("target").isNotNull()).select(*KEYS).distinct()
    gone = changes.filter(F.col("operation_type") == DELETE)
    sure = gone.join(keys, [*KEYS], "left_anti").join(days, ["date", "base"], "left_anti")
    kept = changes.filter(F.col("operation_type") != DELETE)
    return kept.unionByName(sure.select(*changes.columns))


def _publish(
    spark: SparkSession, tables: Tables, events_path: str | None, run_ts: datetime | str | None
) -> None:
    """Write the quality rows and events that are noted as left out, each exactly once.

    What is published belongs to the staged folder that it comes from, and replaces what
    that folder has published before. A note goes once its rows are written; a failure in
    between writes the same rows to the same place again.
    """
    left = unpublished(spark, tables.base)
    for path in list(left.get("quality", [])):
        report = coverage_report(spark.read.parquet(path), run_ts=run_ts)
        report = report.withColumn("batch", F.lit(_batch_of(path)))
        load(report, tables.quality, "overwrite_partitions", partition_by=("batch",))
        left["quality"].remove(path)
        note_unpublished(spark, tables.base, left)
    if events_path is None:
        return
    for path in list(left.get("events", [])):
        write_events(to_events(spark.read.parquet(path)), events_path, batch=_batch_of(path))
        left["events"].remove(path)
        note_unpublished(spark, tables.base, left)


def _batch_of(path: str) -> str:
    """The name of a batch: that of its staged folder, which is never used twice."""
    return path.rstrip("/").rsplit("/", 1)[-1]


def rebuild(spark: SparkSession, tables: Tables, run_ts: datetime | str | None = None) -> None:
    """Compute the derived tables again from all live rows of the base table."""
    live = live_rows(spark.table(tables.base))
    rows = live.select(*CHANGES.fieldNames())
    tails = _by_month(chunk_tails(rows, calendar_month()))
    _write_all(tails, tables.tails)
    _write_all(monthly_summary(live, run_ts=run_ts), tables.monthly)
    _write_all(rolling_metrics(rows, run_ts=run_ts), tables.enriched)
    _write_all(flag_anomalies(spark.table(tables.enriched)), tables.anomalies)
    note_pending(spark, tables.base, [])


def _write_all(df: DataFrame, table: str) -> None:
    """Make ``df`` the content of a table partitioned by month."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        replace_months(with_month(df), table, stored_months(spark, table))
    else:
        load(df, table, "append")


def _refresh(
    spark: SparkSession,
    tables: Tables,
    changes: DataFrame,
    changed: list[Month],
    pending: list[Month],
    run_ts: datetime | str | None,
) -> None:
    """Compute again what the changes reach: single months of single pairs.

    The monthly table comes first: its counts tell which months of a touched pair have
    frames that reach a changed row. Those months' own rows, and the stored tail before
    the first of them, are all that is read of the base table; a pair without changes,
    and an old month of a sparse one, is not.
    """
    if not all(spark.catalog.tableExists(name) for name in tables.derived()):
        return rebuild(spark, tables, run_ts)
    base = spark.table(tables.base)
    stale = sorted({*changed, *pending})
    # Of a month held back, which pairs changed is not known: all that have rows
    # there count as touched, with those whose rows are all deleted.
    touched = changes.select(*CELL).unionByName(in_months(base, pending).select(*CELL))
    touched = staged(touched.distinct(), "touched")
    named = _is_touched_pair(touched)
    live = live_rows(base).filter(named)

    mine = in_months(live, stale).join(touched, [*CELL], "left_semi")
    _replace_cells(monthly_summary(mine, run_ts=run_ts), tables.monthly, touched, stale)
    pairs = touched.select(*PAIR).distinct()
    counts = spark.table(tables.monthly).filter(named).join(pairs, [*PAIR], "left_semi")
    counts = counts.select(*CELL, F.col("observations_count").alias("n"))
    stored = spark.table(tables.tails).filter(named).select(*CELL, "tail")
    cells = staged(affected_cells(counts, touched, stored, LONG_FRAME - 1), "cells")
    alive = cells.filter("n > 0")
    rows = in_months(live, months_of(alive)).join(alive.select(*CELL), [*CELL], "left_semi")
    tails = staged(next_tails(rows, cells, LONG_FRAME - 1), "tails")

    affected = cells.filter("affected")
    months = months_of(affected)
    history = rows.join(affected.select(*CELL), [*CELL], "left_semi")
    leads = tails.select(*PAIR, _month_text().alias("_chunk"), "tail")
    metrics = rolling_metrics(
        history.select(*CHANGES.fieldNames()), run_ts=run_ts, chunk=calendar_month(), tails=leads
    )
    metrics = staged(with_month(metrics), "metrics")
    _replace_cells(metrics, tables.enriched, affected, months)
    _replace_cells(flag_anomalies(metrics), tables.anomalies, affected, months)
    _replace_cells(tails, tables.tails, affected, months)
    note_pending(spark, tables.base, [])


def _is_touched_pair(touched: DataFrame) -> Column:
    """A test on the pair's columns that a scan can use, if few pairs are touched.

    It only spares reading; which rows count is for the joins. The driver holds at most
    MOST_PAIRS names.
    """
    found = touched.select(*PAIR).distinct().limit(MOST_PAIRS + 1).collect()
    if len(found) > MOST_PAIRS or any(None in row for row in found):
        return F.lit(True)
    return reduce(and_, [F.col(name).isin(sorted({row[name] for row in found})) for name in PAIR])


def _replace_cells(rows: DataFrame, table: str, cells: DataFrame, months: list[Month]) -> None:
    """Make ``rows`` the content of the cells; the other rows of these months stay."""
    stored = in_months(rows.sparkSession.table(table), months)
    kept = stored.join(cells.select(*CELL), [*CELL], "left_anti")
    replace_months(kept.unionByName(with_month(rows).select(*kept.columns)), table, months)


def _month_text() -> Column:
    """The month as the text that :func:`calendar_month` gives for its days."""
    return F.concat_ws(
        "-", F.lpad(F.col("year").cast("string"), 4, "0"), F.lpad(F.col("month").cast("string"), 2, "0")
    )


def _by_month(tails: DataFrame) -> DataFrame:
    """Tails as rows of their table, which has the month for the chunk."""
    return tails.select(
        *PAIR,
        "tail",
        F.substring("_chunk", 1, 4).cast("int").alias("year"),
        F.substring("_chunk", 6, 2).cast("int").alias("month"),
    )


def affected_cells(
    counts: DataFrame, touched: DataFrame, tails: DataFrame, reach: int
) -> DataFrame:
    """The months of touched pairs that are to be computed again, in stretches.

    ``counts``: live rows of each pair and month (n), ``touched``: months of pairs with
    changes, ``tails``: the stored tails. A later month of a pair is out of reach once
    ``reach`` rows of the pair lie between it and the last touched month before it.

    ``affected`` tells those months. A stretch of them (``stretch``) follows from its own
    rows and the tail of its first month (``tail``, on each row), which no change reaches.
    If that month is new it has no tail, and the month before it is taken along.
    """
    ordered = Window.partitionBy(*PAIR).orderBy(month_number("year", "month"))
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    through = F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    last_touched = F.last(F.when(F.col("touched"), F.col("through")), ignorenulls=True)
    none = F.array().cast("array<struct<date:string,rate:double>>")
    cells = (
        counts.join(touched.withColumn("touched", F.lit(True)), [*CELL], "full")
        .withColumns(
            {
                "n": F.coalesce("n", F.lit(0)),
                "touched": F.coalesce("touched", F.lit(False)),
            }
        )
        .withColumn("through", through)
        .withColumn("between", F.col("through") - F.col("n") - last_touched.over(earlier))
        .withColumn("affected", F.col("touched") | F.coalesce(F.col("between") < reach, F.lit(False)))
        .join(tails, [*CELL], "left")
    )
    before = F.coalesce(F.lag("affected").over(ordered), F.lit(False))
    lacks = F.col("affected") & ~before & F.col("tail").isNull()
    member = F.col("affected") | F.coalesce(F.lead("lacks").over(ordered), F.lit(False))
    starts = F.col("member") & ~F.coalesce(F.lag("member").over(ordered), F.lit(False))
    nth = F.sum(F.col("starts").cast("int")).over(ordered)
    stretch = Window.partitionBy(*PAIR, "stretch")
    first_tail = F.max(F.when(F.col("starts"), F.coalesce("tail", none))).over(stretch)
    return (
        cells.withColumn("lacks", lacks)
        .withColumn("member", member)
        .withColumn("starts", starts)
        .withColumn("stretch", nth)
        .filter("member")
        .withColumn("tail", first_tail)
        .select(*CELL, "n", "affected", "stretch", "tail")
    )


def next_tails(rows: DataFrame, cells: DataFrame, reach: int) -> DataFrame:
    """The tails of affected months that have rows, from the rows of their stretches.

    Within a stretch a tail is the last rows of the first month's tail and all months in
    between; each month has a row, so it reaches over ``reach`` months at most.
    """
    day_rates = F.sort_array(F.collect_list(F.struct("date", "rate")))
    own = rows.groupBy(*CELL).agg(day_rates.alias("own")).withColumn("own", last_of("own", reach))
    ordered = Window.partitionBy(*PAIR, "stretch").orderBy(month_number("year", "month"))
    before = F.flatten(F.collect_list("own").over(ordered.rowsBetween(-reach, -1)))
    return (
        cells.join(own, [*CELL])
        .withColumn("tail", F.concat("tail", before))
        .filter("affected")
        .select(*PAIR, last_of("tail", reach).alias("tail"), "year", "month")
    )

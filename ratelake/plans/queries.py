"""The registered queries: every operator over the whole of the order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators import (
    clean_rates,
    convert_transactions,
    coverage_from_bitmaps,
    coverage_gaps,
    coverage_report,
    coverage_summary,
    day_bitmaps,
    days_covered,
    delete_gate,
    detect_changes,
    detect_changes_by_digest,
    differing_cells,
    dimension,
    drop_report,
    fact_rates,
    fact_transactions,
    flag_anomalies,
    in_range,
    live_rows,
    merge_bitmaps,
    merge_changes,
    merge_moments,
    monthly_moments,
    monthly_summary,
    rolling_metrics,
    stored_digests,
    summary_of,
    to_events,
    updated_moments,
)
from ratelake.plans.batch import Batch, Tables, run_batch
from ratelake.plans.order_rates import (
    FIRST_RUN,
    SECOND_RUN,
    THIRD_RUN,
    decimal_text,
    damaged_documents,
    dirty_ticks,
    documents,
    new_snapshot,
    old_snapshot,
    paid_lines,
    rates,
    stored_rows,
    table,
    ticks,
    transactions,
    wide_documents,
)
from ratelake.schemas import KEYS, PAIR
from ratelake.sources.documents import (
    flatten_documents,
    flatten_rates,
    parse_documents,
    read_documents,
    rejected,
)
from ratelake.sources.event_files import write_events
from ratelake.sources.shared import shared_folder, staged
from ratelake.sources.tables import load, months_of, with_month

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# The range of the second batch; the first one covers everything.
LO, HI = "1997-03-15", "1998-10-20"
# The range of the third batch, inside the second.
LO_3, HI_3 = "1997-09-10", "1997-11-05"
FIRST_DAY, LAST_DAY = "1990-01-01", "2010-12-31"


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        return function

    return register


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def _six(*names: str) -> list[Column]:
    return [F.round(name, 6).alias(name) for name in names]


def _stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSS").alias(name)


def _change_view(changes: DataFrame) -> DataFrame:
    return changes.select(
        *KEYS,
        "base_amount",
        *_six("rate"),
        "row_hash",
        "operation_type",
        _stamp("ingested_at"),
        _stamp("updated_at"),
    )


def _stored_view(rows: DataFrame) -> DataFrame:
    return rows.select(
        *KEYS,
        "base_amount",
        *_six("rate"),
        "row_hash",
        "operation_type",
        _stamp("ingested_at"),
        _stamp("ingestion_timestamp"),
        _stamp("updated_at"),
    )


# --- cleaning and ranges


@query("clean_rates")
def query_clean_rates(spark, sf_dir):
    return rates(spark, sf_dir).select(*KEYS, "base_amount", *_six("rate"), "src_id")


@query("clean_dirty_rates")
def query_clean_dirty_rates(spark, sf_dir):
    cleaned = clean_rates(dirty_ticks(spark, sf_dir), tie_break=["src_id"])
    return cleaned.select(*KEYS, *_six("rate"), "src_id")


@query("clean_drop_report")
def query_clean_drop_report(spark, sf_dir):
    return drop_report(dirty_ticks(spark, sf_dir))


@query("date_range_filter")
def query_date_range_filter(spark, sf_dir):
    return in_range(rates(spark, sf_dir), LO, HI).select(*KEYS, *_six("rate"))


# --- documents


@query("flatten_documents")
def query_flatten_documents(spark, sf_dir):
    """Every order lands as a JSON document; files are read, flattened and cleaned."""
    path = shared_folder(spark, "documents")
    documents(ticks(spark, sf_dir)).write.text(path)
    flat = clean_rates(flatten_rates(read_documents(spark, path), FIRST_RUN))
    return flat.select(*KEYS, "base_amount", *_six("rate"), _stamp("ingested_at"))


@query("flatten_text_column")
def query_flatten_text_column(spark, sf_dir):
    """The same from a text column, duplicates kept; totals per currency."""
    flat = flatten_rates(parse_documents(documents(ticks(spark, sf_dir))), FIRST_RUN)
    return flat.groupBy("base", "target").agg(
        F.count("*").alias("observations"),
        F.countDistinct("date").alias("dates"),
        F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"),
    )


@query("flatten_rejects")
def query_flatten_rejects(spark, sf_dir):
    """What is wrong with the damaged ones of all documents, by kind and currency."""
    landed = parse_documents(damaged_documents(ticks(spark, sf_dir)))
    return (
        rejected(flatten_documents(landed, FIRST_RUN))
        .groupBy("problem", "target")
        .agg(F.count("*").alias("rejects"), F.countDistinct("date").alias("dates"))
    )


@query("flatten_wide_documents")
def query_flatten_wide_documents(spark, sf_dir):
    """Documents of many days and currencies, some without a base, numbers also whole."""
    flat = flatten_rates(parse_documents(wide_documents(rates(spark, sf_dir))), FIRST_RUN)
    return flat.select(*KEYS, "base_amount", *_six("rate"), _stamp("ingested_at"))


@query("flatten_latest_document")
def query_flatten_latest_document(spark, sf_dir):
    """Several documents for a day and currency: the one that came in last counts."""
    observed = ticks(spark, sf_dir)
    by_day = F.create_map("date", F.create_map("target", "rate"))
    texts = observed.select(
        F.to_json(F.struct("base", by_day.alias("rates"))).alias("value"),
        F.timestamp_seconds("src_id").alias("received_at"),
        F.lit("landed").alias("source_path"),
    )
    flat = flatten_documents(parse_documents(texts), FIRST_RUN)
    latest = clean_rates(flat, tie_break=["-received_at"])
    return latest.select(*KEYS, *_six("rate"))


# --- change detection and merge


def _changes(spark, sf_dir, with_tombstones=False, **options) -> DataFrame:
    stored = stored_rows(old_snapshot(spark, sf_dir), with_tombstones)
    return detect_changes(
        new_snapshot(spark, sf_dir), stored, run_ts=SECOND_RUN, as_text=decimal_text, **options
    )


def _first_load(spark, sf_dir) -> DataFrame:
    return detect_changes(rates(spark, sf_dir), None, run_ts=FIRST_RUN, as_text=decimal_text)


def _merged(spark, sf_dir, with_tombstones=False, tombstones="latched") -> DataFrame:
    changes = _changes(spark, sf_dir, with_tombstones, tombstones=tombstones)
    stored = stored_rows(old_snapshot(spark, sf_dir), with_tombstones)
    return merge_changes(stored, changes, revive=tombstones == "strict")


@query("cdc_changes")
def query_cdc_changes(spark, sf_dir):
    return _change_view(_changes(spark, sf_dir))


@query("cdc_changes_in_range")
def query_cdc_changes_in_range(spark, sf_dir):
    return _change_view(_changes(spark, sf_dir, lo=LO, hi=HI))


@query("cdc_changes_by_digest")
def query_cdc_changes_by_digest(spark, sf_dir):
    """What comes in differs from what is stored within the second range only; of the rest
    the digests are equal, so only the range's months are read and joined."""
    old, new = old_snapshot(spark, sf_dir), new_snapshot(spark, sf_dir)
    inside = F.col("date").between(LO, HI)
    incoming = with_month(old.filter(~inside).unionByName(new.filter(inside)))
    name = f"{_database(spark, 'digests')}.rates"
    stored, _ = load(stored_rows(old), name)
    digests = staged(stored_digests(stored, decimal_text), "digests")
    span = {"lo": FIRST_DAY, "hi": LAST_DAY, "as_text": decimal_text}
    cells = staged(differing_cells(incoming, digests, **span), "differing")
    changes = detect_changes_by_digest(
        incoming, stored, cells, months_of(cells), run_ts=SECOND_RUN, **span
    )
    return _change_view(changes)


@query("month_digests")
def query_month_digests(spark, sf_dir):
    """How many rows each digest covers, with tombstones and without; no row is in two."""
    stored = with_month(stored_rows(old_snapshot(spark, sf_dir), with_tombstones=True))
    return stored_digests(stored).select(*PAIR, "year", "month", "live", "n")


@query("cdc_initial_load")
def query_cdc_initial_load(spark, sf_dir):
    return _change_view(_first_load(spark, sf_dir))


@query("cdc_empty_batch")
def query_cdc_empty_batch(spark, sf_dir):
    """Nothing comes in for the range: each stored row of it is a DELETE."""
    stored = stored_rows(old_snapshot(spark, sf_dir))
    nothing = new_snapshot(spark, sf_dir).filter(F.col("rate").isNull())
    changes = detect_changes(
        nothing, stored, lo=LO, hi=HI, run_ts=SECOND_RUN, as_text=decimal_text
    )
    return _change_view(changes)


@query("cdc_latched_tombstones")
def query_cdc_latched_tombstones(spark, sf_dir):
    return _change_view(_changes(spark, sf_dir, with_tombstones=True))


@query("cdc_strict_tombstones")
def query_cdc_strict_tombstones(spark, sf_dir):
    return _change_view(_changes(spark, sf_dir, with_tombstones=True, tombstones="strict"))


@query("cdc_default_hash")
def query_cdc_default_hash(spark, sf_dir):
    """Rows compared, and hashed, by the plain text of the rate (here of four decimals)."""
    stored = stored_rows(old_snapshot(spark, sf_dir).withColumn("rate", F.round("rate", 4)))
    incoming = new_snapshot(spark, sf_dir).withColumn("rate", F.round("rate", 4))
    return _change_view(detect_changes(incoming, stored, run_ts=SECOND_RUN))


@query("cdc_op_counts")
def query_cdc_op_counts(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    return changes.groupBy("operation_type").agg(F.count("*").alias("row_count"))


@query("delete_gate")
def query_delete_gate(spark, sf_dir):
    return delete_gate(_changes(spark, sf_dir))


@query("merge_snapshot")
def query_merge_snapshot(spark, sf_dir):
    return _stored_view(_merged(spark, sf_dir))


@query("merge_live_rows")
def query_merge_live_rows(spark, sf_dir):
    return live_rows(_merged(spark, sf_dir)).select(*KEYS, *_six("rate"), "operation_type")


@query("merge_tombstones")
def query_merge_tombstones(spark, sf_dir):
    return _stored_view(_merged(spark, sf_dir, with_tombstones=True))


@query("merge_strict_revival")
def query_merge_strict_revival(spark, sf_dir):
    return _stored_view(_merged(spark, sf_dir, with_tombstones=True, tombstones="strict"))


# --- tables


def _database(spark: SparkSession, name: str) -> str:
    """A new database whose tables lie in the shared folder."""
    path = shared_folder(spark, name)
    database = path.rsplit("/", 1)[-1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    return database


@query("load_append")
def query_load_append(spark, sf_dir):
    """Two loads of one snapshot and the next: the first creates, the second appends."""
    name = f"{_database(spark, 'append')}.rates"
    load(stored_rows(old_snapshot(spark, sf_dir)), name, "append")
    loaded, _ = load(stored_rows(new_snapshot(spark, sf_dir)), name, "append")
    return loaded.groupBy("year", "month", "target").agg(
        F.count("*").alias("row_count"), F.round(F.sum("rate"), 4).alias("rate_total")
    )


@query("load_overwrite_partitions")
def query_load_overwrite_partitions(spark, sf_dir):
    """The months of the second range are replaced by the new snapshot, others stay."""
    name = f"{_database(spark, 'overwrite')}.rates"
    load(stored_rows(old_snapshot(spark, sf_dir)), name, "overwrite_partitions")
    part = in_range(new_snapshot(spark, sf_dir), "1997-04-01", "1998-09-30")
    loaded, _ = load(stored_rows(part), name, "overwrite_partitions")
    return loaded.select(*KEYS, *_six("rate"), "year", "month")


@query("load_merge_cdc")
def query_load_merge_cdc(spark, sf_dir):
    """Changes of a range are detected against a table and merged into it."""
    name = f"{_database(spark, 'merge')}.rates"
    stored, _ = load(stored_rows(old_snapshot(spark, sf_dir)), name, "merge_cdc")
    changes = detect_changes(
        new_snapshot(spark, sf_dir), stored, lo=LO, hi=HI, run_ts=SECOND_RUN, as_text=decimal_text
    )
    loaded, deletes = load(staged(changes, "changes"), name, "merge_cdc")
    return _stored_view(loaded).withColumn("has_deletes", F.lit(deletes))


# --- metrics, anomalies, summaries


def _metrics(spark, sf_dir) -> DataFrame:
    return rolling_metrics(_first_load(spark, sf_dir), run_ts=FIRST_RUN)


_METRIC_NAMES = ("rate", "daily_variation_pct", "sma_7d", "sma_30d", "volatility_30d")


@query("rolling_metrics")
def query_rolling_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select(
        *KEYS, "base_amount", _stamp("updated_at"), *_six(*_METRIC_NAMES)
    )


@query("anomaly_flags")
def query_anomaly_flags(spark, sf_dir):
    flagged = flag_anomalies(_metrics(spark, sf_dir))
    return flagged.select(*KEYS, *_six(*_METRIC_NAMES), "is_anomaly", "z_score")


@query("anomalies_only")
def query_anomalies_only(spark, sf_dir):
    flagged = flag_anomalies(_metrics(spark, sf_dir)).filter("is_anomaly")
    return flagged.select(*KEYS, *_six("rate"), "z_score")


def _summary_view(summary: DataFrame) -> DataFrame:
    return summary.select(
        *PAIR,
        "year",
        "month",
        "avg_rate",
        *_six("min_rate", "max_rate"),
        "monthly_volatility",
        "observations_count",
    )


@query("monthly_summary")
def query_monthly_summary(spark, sf_dir):
    return _summary_view(monthly_summary(rates(spark, sf_dir)))


@query("monthly_summary_merged")
def query_monthly_summary_merged(spark, sf_dir):
    """The summary after a batch of inserts, updates and deletes, from stored states."""
    stored = stored_rows(old_snapshot(spark, sf_dir))
    states = staged(monthly_moments(stored), "moments")
    changes = staged(with_month(_changes(spark, sf_dir, lo=LO, hi=HI)), "changes")
    live = with_month(live_rows(merge_changes(stored, changes)))
    return _summary_view(summary_of(updated_moments(states, changes, live)))


@query("monthly_summary_of_inserts")
def query_monthly_summary_of_inserts(spark, sf_dir):
    """Two batches of inserts: their states are merged, no stored row is read."""
    late = F.col("priority") == "1-URGENT"
    first, second = (
        staged(monthly_moments(rates(spark, sf_dir).filter(part)), "moments")
        for part in (~late, late)
    )
    return _summary_view(summary_of(merge_moments(first, second)))


@query("monthly_summary_sorted")
def query_monthly_summary_sorted(spark, sf_dir):
    """The reading order: year, month, currency."""
    return _summary_view(monthly_summary(rates(spark, sf_dir))).orderBy("year", "month", "target")


# --- calendar coverage


def _report_view(report: DataFrame, *by: str) -> DataFrame:
    day = F.col("dq_date").cast("string").alias("dq_date")
    return report.select(*by, day, "day_type", "status_detail", "is_missing")


def _coverage_totals(summary: DataFrame, *by: str) -> DataFrame:
    return summary.select(
        *by,
        F.col("first_date").cast("string").alias("first_date"),
        F.col("last_date").cast("string").alias("last_date"),
        "total_days",
        "missing_days",
        "missing_weekdays",
        "missing_weekends",
        "coverage_pct",
    )


@query("coverage_report")
def query_coverage_report(spark, sf_dir):
    return _report_view(coverage_report(rates(spark, sf_dir)))


@query("coverage_summary")
def query_coverage_summary(spark, sf_dir):
    return _coverage_totals(coverage_summary(coverage_report(rates(spark, sf_dir))))


@query("coverage_by_pair")
def query_coverage_by_pair(spark, sf_dir):
    return _report_view(coverage_report(rates(spark, sf_dir), by=PAIR), *PAIR)


@query("coverage_summary_by_pair")
def query_coverage_summary_by_pair(spark, sf_dir):
    report = coverage_report(rates(spark, sf_dir), by=PAIR)
    return _coverage_totals(coverage_summary(report, by=PAIR), *PAIR)


@query("coverage_gaps")
def query_coverage_gaps(spark, sf_dir):
    return _report_view(coverage_gaps(rates(spark, sf_dir), by=PAIR), *PAIR)


def _bitmaps_of_two_batches(spark, sf_dir) -> DataFrame:
    """The days of both snapshots, each stored as a batch left them, then merged."""
    first, second = (
        staged(day_bitmaps(snapshot(spark, sf_dir)), "bitmaps")
        for snapshot in (old_snapshot, new_snapshot)
    )
    return staged(merge_bitmaps(first, second), "bitmaps")


@query("coverage_from_bitmaps")
def query_coverage_from_bitmaps(spark, sf_dir):
    """The report over all history from merged bitmaps of days, for all pairs together."""
    return _report_view(coverage_from_bitmaps(_bitmaps_of_two_batches(spark, sf_dir)))


@query("coverage_from_bitmaps_by_pair")
def query_coverage_from_bitmaps_by_pair(spark, sf_dir):
    report = coverage_from_bitmaps(_bitmaps_of_two_batches(spark, sf_dir), by=PAIR)
    return _report_view(report, *PAIR)


@query("days_covered")
def query_days_covered(spark, sf_dir):
    return days_covered(_bitmaps_of_two_batches(spark, sf_dir))


@query("newest_dq_rows")
def query_newest_dq_rows(spark, sf_dir):
    report = coverage_report(rates(spark, sf_dir))
    return _report_view(report.orderBy(F.desc("dq_date")).limit(5))


# --- star schema


def _customers(spark, sf_dir) -> DataFrame:
    return dimension(
        table(spark, sf_dir, "customer"),
        {"customer_id": "c_custkey", "customer_name": "c_name", "segment": "c_mktsegment"},
    )


@query("dim_customer")
def query_dim_customer(spark, sf_dir):
    return _customers(spark, sf_dir)


@query("dim_currency")
def query_dim_currency(spark, sf_dir):
    return dimension(
        table(spark, sf_dir, "nation"), {"currency_code": "n_nationkey", "currency_name": "n_name"}
    )


@query("fact_rates")
def query_fact_rates(spark, sf_dir):
    facts = fact_rates(_changes(spark, sf_dir))
    return facts.select(*KEYS, *_six("rate"), _stamp("ingestion_timestamp"))


@query("fact_rates_without_stamp")
def query_fact_rates_without_stamp(spark, sf_dir):
    """Rows without ``ingestion_timestamp``: the time they came in takes its place."""
    rows = _changes(spark, sf_dir).drop("ingestion_timestamp")
    return fact_rates(rows).select(*KEYS, *_six("rate"), _stamp("ingestion_timestamp"))


@query("fact_transactions")
def query_fact_transactions(spark, sf_dir):
    source = {
        "transaction_id": "transaction_id",
        "date": "l_shipdate",
        "customer_id": "o_custkey",
        "target_currency": "n_name",
        "local_amount": "l_extendedprice",
    }
    facts = fact_transactions(paid_lines(spark, sf_dir), source)
    return facts.withColumn("customer_id", F.col("customer_id").cast("long"))


@query("converted_transactions")
def query_converted_transactions(spark, sf_dir):
    report = convert_transactions(
        transactions(spark, sf_dir),
        _customers(spark, sf_dir),
        fact_rates(_first_load(spark, sf_dir)),
    )
    return report.withColumn("daily_rate", F.round("daily_rate", 6))


@query("converted_transactions_two_bases")
def query_converted_transactions_two_bases(spark, sf_dir):
    """Rates of two bases in the table; only those of the asked base count."""
    first = rates(spark, sf_dir)
    second = first.filter(F.col("priority") != "5-LOW").withColumns(
        {"base": F.lit("EUR"), "rate": F.col("rate") * 1.5}
    )
    report = convert_transactions(
        transactions(spark, sf_dir),
        _customers(spark, sf_dir),
        first.unionByName(second),
        base="EUR",
    )
    return report.withColumn("daily_rate", F.round("daily_rate", 6))


# --- events


def _event_view(events: DataFrame) -> DataFrame:
    return events.select(
        "event_type",
        "event_timestamp",
        "entity_id",
        "payload.date",
        "payload.base",
        "payload.target",
        "payload.base_amount",
        F.round("payload.rate", 6).alias("rate"),
        "payload.row_hash",
    )


@query("change_events")
def query_change_events(spark, sf_dir):
    return _event_view(to_events(_changes(spark, sf_dir)))


@query("change_events_json_roundtrip")
def query_change_events_json_roundtrip(spark, sf_dir):
    events = to_events(_changes(spark, sf_dir))
    path = shared_folder(spark, "events")
    write_events(events, path)
    return _event_view(spark.read.schema(events.schema).json(path))


# --- whole batches


_STEPS = (
    (old_snapshot, FIRST_DAY, LAST_DAY, FIRST_RUN),
    (new_snapshot, LO, HI, SECOND_RUN),
    (old_snapshot, LO_3, HI_3, THIRD_RUN),
)


def _two_batches(spark, sf_dir, steps=_STEPS[:2], **options) -> tuple[Tables, Batch]:
    """The old snapshot in one batch, then the new one for the narrower range."""
    tables = Tables.in_database(_database(spark, "batches"))
    for snapshot, lo, hi, run_ts in steps:
        landed = parse_documents(documents(snapshot(spark, sf_dir)))
        batch = run_batch(landed, tables, lo, hi, run_ts=run_ts, **options)
    return tables, batch


@query("two_batches_base")
def query_two_batches_base(spark, sf_dir):
    tables, _ = _two_batches(spark, sf_dir)
    return spark.table(tables.base).select(
        *KEYS,
        "base_amount",
        *_six("rate"),
        "operation_type",
        _stamp("ingested_at"),
        _stamp("updated_at"),
    )


@query("two_batches_enriched")
def query_two_batches_enriched(spark, sf_dir):
    tables, _ = _two_batches(spark, sf_dir, on_delete="continue")
    return spark.table(tables.enriched).select(*KEYS, *_six(*_METRIC_NAMES))


@query("three_batches_enriched")
def query_three_batches_enriched(spark, sf_dir):
    """The third batch goes back to the old snapshot for some weeks inside the second."""
    tables, _ = _two_batches(spark, sf_dir, steps=_STEPS, on_delete="continue")
    return spark.table(tables.enriched).select(*KEYS, *_six(*_METRIC_NAMES))


@query("three_batches_tails")
def query_three_batches_tails(spark, sf_dir):
    """The state that the next increment starts from: the rows before each pair's months."""
    tables, _ = _two_batches(spark, sf_dir, steps=_STEPS, on_delete="continue")
    tails = spark.table(tables.tails)
    total = F.aggregate("tail", F.lit(0.0), lambda sum, row: sum + row["rate"])
    return tails.select(
        *PAIR,
        "year",
        "month",
        F.size("tail").alias("row_count"),
        F.try_element_at("tail.date", F.lit(1)).alias("first_date"),
        F.try_element_at("tail.date", F.lit(-1)).alias("last_date"),
        F.round(total, 4).alias("rate_total"),
    )


@query("two_batches_changes_scope")
def query_two_batches_changes_scope(spark, sf_dir):
    """The other scope: the enriched table holds the metrics of the last changes alone."""
    tables, _ = _two_batches(spark, sf_dir, scope="changes", on_delete="continue")
    return spark.table(tables.enriched).select(*KEYS, *_six(*_METRIC_NAMES))


@query("two_batches_quality")
def query_two_batches_quality(spark, sf_dir):
    """The quality rows of both batches, each over what came in."""
    tables, _ = _two_batches(spark, sf_dir, on_delete="continue")
    return _report_view(spark.table(tables.quality), "execution_timestamp").withColumn(
        "execution_timestamp", _stamp("execution_timestamp")
    )


@query("two_batches_events")
def query_two_batches_events(spark, sf_dir):
    """The events of both batches, read back from where they were published."""
    path = shared_folder(spark, "events")
    _two_batches(spark, sf_dir, on_delete="continue", events_path=path)
    schema = to_events(_changes(spark, sf_dir)).schema
    return _event_view(spark.read.schema(schema).json(path)).drop("row_hash")


@query("two_batches_anomalies")
def query_two_batches_anomalies(spark, sf_dir):
    tables, _ = _two_batches(spark, sf_dir, on_delete="continue")
    return spark.table(tables.anomalies).select(*KEYS, *_six("rate"), "is_anomaly", "z_score")


@query("two_batches_monthly")
def query_two_batches_monthly(spark, sf_dir):
    tables, _ = _two_batches(spark, sf_dir, on_delete="continue")
    return _summary_view(spark.table(tables.monthly))


@query("two_batches_report")
def query_two_batches_report(spark, sf_dir):
    """The converted transactions at the live rates after both batches."""
    _, batch = _two_batches(
        spark,
        sf_dir,
        on_delete="continue",
        transactions=transactions(spark, sf_dir),
        customers=_customers(spark, sf_dir),
    )
    return batch.report.withColumn("daily_rate", F.round("daily_rate", 6))


@query("table_row_counts")
def query_table_row_counts(spark, sf_dir):
    """Rows per table after a batch that stops at its deletes: only the base moves."""
    tables, batch = _two_batches(spark, sf_dir)
    counts = None
    for label in ("base", "enriched", "monthly", "anomalies", "quality"):
        one = spark.table(getattr(tables, label)).agg(
            F.lit(label).alias("table_name"), F.count("*").alias("total")
        )
        counts = one if counts is None else counts.unionAll(one)
    return counts.withColumn("status", F.lit(batch.status))

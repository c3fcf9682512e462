"""The shape of the physical plans: what must hold on any amount of data."""

import re

import pytest
from pyspark.sql import functions as F

from ratelake.operators import (
    clean_rates,
    convert_transactions,
    coverage_report,
    detect_changes,
    fact_rates,
    live_rows,
    merge_changes,
    monthly_summary,
    rolling_metrics,
)
from ratelake.sources.shared import shared_folder, staged
from ratelake.sources.tables import in_months, load
from tests.test_operators import DAY, RUN_2, rates_frame, stored_frame


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan after it ran, as adaptive execution left it."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def base(spark):
    name = shared_folder(spark, "plans").rsplit("/", 1)[-1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {name}")
    rows = [(f"2026-{month:02d}-06", "A", 1.0 + month, "INSERT") for month in range(1, 13)]
    load(stored_frame(spark, rows), f"{name}.rates")
    yield spark.table(f"{name}.rates")
    spark.sql(f"DROP DATABASE {name} CASCADE")


@pytest.fixture
def no_broadcast(spark):
    """As if every side were too large to broadcast."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    yield
    spark.conf.set(setting, before)


def scans(text):
    return [line for line in text.splitlines() if "FileScan" in line]


def test_duplicates_are_reduced_before_the_shuffle(base):
    text = plan(clean_rates(base))
    exchange = text.index("Exchange hashpartitioning")
    assert 0 < text.index("Final") < exchange < text.index("Partial")
    assert text.count("Exchange hashpartitioning") == 1


def test_change_detection_reads_the_months_and_columns_it_needs(spark, base, no_broadcast):
    incoming = rates_frame(spark, [(DAY, "A", 2.0)])
    text = plan(detect_changes(incoming, base, lo="2026-05-02", hi="2026-06-03", run_ts=RUN_2))
    assert "FullOuter" in text and text.count("Exchange hashpartitioning") == 2
    (scan,) = scans(text)
    assert "GreaterThanOrEqual(date,2026-05-02)" in scan
    assert "LessThanOrEqual(date,2026-06-03)" in scan
    assert re.search(r"PartitionFilters: \[[^\]]*year", scan)
    assert "row_hash" not in scan and "operation_type" not in scan
    cut = detect_changes(incoming, base, lo="2026-05-02", hi="2026-06-03")
    months = {path.split("month=")[1].split("/")[0] for path in cut.inputFiles()}
    assert months == {"5", "6"}


def test_a_few_changes_move_no_stored_row(spark, base):
    changes = detect_changes(rates_frame(spark, [(DAY, "A", 2.0)]), None, run_ts=RUN_2)
    text = plan(merge_changes(base, staged(changes, "changes")))
    # Only keys that both sides have, and changes, are shuffled for the anti join.
    assert "FullOuter" not in text and text.count("SortMergeJoin") == 1
    assert text.count("BroadcastHashJoin") == 2, "stored rows meet the changes where they are"


def test_many_changes_are_shuffled(spark, base, no_broadcast):
    changes = detect_changes(rates_frame(spark, [(DAY, "A", 2.0)]), None, run_ts=RUN_2)
    text = plan(merge_changes(base, changes))
    assert "Broadcast" not in text and "FullOuter" not in text


def test_summary_aggregates_before_the_shuffle(base):
    text = plan(monthly_summary(live_rows(base)))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.index("partial_avg") > text.index("Exchange hashpartitioning")
    (scan,) = scans(text)
    schema = re.search(r"ReadSchema: struct<(.*)>", scan).group(1)
    assert schema == "date:string,base:string,target:string,rate:double,operation_type:string"


def test_metrics_never_shuffle_rows_by_pair_alone(base):
    text = plan(rolling_metrics(base.drop("year", "month")))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    by_pair = [key for key in keys if "_chunk" not in key]
    assert len(by_pair) == 1, "only the chunk tails meet by pair"
    below = text[text.index("Exchange hashpartitioning(" + by_pair[0]) :]
    assert "collect_list" in below.splitlines()[1]
    assert below.index("Final") < below.index("Partial")


def test_coverage_shuffles_days_only(base):
    """What crosses the network is a partial aggregate or the distinct days, never rows."""
    text = plan(coverage_report(base))
    assert len(scans(text)) == 1 and "Join" not in text
    assert text.count("HashAggregate") == 2
    for match in re.finditer(r"Exchange (hashpartitioning|SinglePartition)", text):
        below = text[match.start() :].splitlines()[1]
        assert "HashAggregate" in below, below


def test_months_select_partitions(base):
    (scan,) = scans(plan(in_months(base, [(2026, 5), (2026, 12)])))
    assert re.search(r"PartitionFilters: \[[^\]]*month", scan)


def test_no_operator_broadcasts_by_hint(spark, base, no_broadcast):
    transactions = base.select(
        F.lit("t").alias("transaction_id"),
        "date",
        F.col("base").alias("customer_id"),
        F.col("target").alias("target_currency"),
        F.col("rate").alias("local_amount"),
    )
    customers = base.select(
        F.col("base").alias("customer_id"),
        F.lit("n").alias("customer_name"),
        F.lit("s").alias("segment"),
    )
    text = plan(convert_transactions(transactions, customers, fact_rates(base)))
    assert "Broadcast" not in text and "Cartesian" not in text


def test_hot_day_is_split(spark, no_broadcast):
    """A third of the transactions on one day and currency: that partition is split."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        i = F.col("id")
        day = F.when(i % 3 == 0, F.lit(0)).otherwise(i % 400)
        transactions = spark.range(0, 60000, 1, 8).select(
            i.cast("string").alias("transaction_id"),
            F.date_add(F.lit("2026-01-01").cast("date"), day.cast("int"))
            .cast("string")
            .alias("date"),
            (i % 100).cast("string").alias("customer_id"),
            F.lit("MXN").alias("target_currency"),
            F.lit(10.0).alias("local_amount"),
        )
        customers = spark.range(100).select(
            i.cast("string").alias("customer_id"),
            F.lit("n").alias("customer_name"),
            F.lit("s").alias("segment"),
        )
        rates = spark.range(400).select(
            F.date_add(F.lit("2026-01-01").cast("date"), i.cast("int"))
            .cast("string")
            .alias("date"),
            F.lit("USD").alias("base"),
            F.lit("MXN").alias("target"),
            F.lit(4.0).alias("rate"),
        )
        report = convert_transactions(transactions, customers, rates)
        text = final_plan(report)
        assert "skew=true" in text
        assert report.count() == 60000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)

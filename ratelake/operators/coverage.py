"""Calendar coverage: which days have no observation."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelake.functions.columns import run_stamp

# The labels of the report.
WEEKDAY = "Weekday"
WEEKEND = "Weekend"
PRESENT = "OK - Data Present"
WEEKEND_GAP = "Missing - Normal Weekend No-Publish"
WEEKDAY_GAP = "CRITICAL - Lost Data / Gap"


def coverage_report(
    df: DataFrame, by: Sequence[str] = (), run_ts: datetime | str | None = None
) -> DataFrame:
    """One row per calendar day from the first to the last date seen.

    A day is covered if any row has it; with ``by``, each group has its own calendar
    and its own gaps, and null is a group like any other. The distinct days are found
    before the shuffle; each is then followed by the days up to the next one, so the
    input is read once and nothing is joined. No row goes to the driver. Text that is no
    date is ignored. Unsorted; sort where the result is read.
    """
    days = _days(df, by).select(
        *by, F.posexplode(F.sequence("_seen", "_until")).alias("_after", "dq_date")
    )
    return _described(days, by, F.col("_after") > 0, run_ts)


def coverage_gaps(
    df: DataFrame, by: Sequence[str] = (), run_ts: datetime | str | None = None
) -> DataFrame:
    """The missing days of :func:`coverage_report` alone."""
    gaps = _days(df, by).filter(F.col("_until") > F.col("_seen"))
    missing = gaps.select(
        *by, F.explode(F.sequence(F.date_add("_seen", 1), F.col("_until"))).alias("dq_date")
    )
    return _described(missing, by, F.lit(True), run_ts)


def _days(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each day seen, and the day before the next one seen (itself for the last).

    Without groups the distinct days of the whole calendar are one window: days, not
    rows, so they are as few as the calendar has.
    """
    seen = (
        df.select(*by, F.try_to_date(F.col("date")).alias("_seen"))
        .filter(F.col("_seen").isNotNull())
        .distinct()
    )
    following = F.lead("_seen").over(Window.partitionBy(*by).orderBy("_seen"))
    return seen.withColumn("_until", F.coalesce(F.date_sub(following, 1), F.col("_seen")))


def _described(
    days: DataFrame, by: Sequence[str], missing: Column, run_ts: datetime | str | None
) -> DataFrame:
    weekend = F.dayofweek("dq_date").isin(1, 7)
    return days.select(
        *by,
        "dq_date",
        F.when(weekend, WEEKEND).otherwise(WEEKDAY).alias("day_type"),
        F.when(~missing, PRESENT)
        .when(weekend, WEEKEND_GAP)
        .otherwise(WEEKDAY_GAP)
        .alias("status_detail"),
        missing.alias("is_missing"),
        run_stamp(run_ts).alias("execution_timestamp"),
    )


def coverage_summary(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a coverage report: days, gaps by kind, and coverage in percent."""
    missing = F.col("is_missing")
    total = F.count("*")
    gaps = F.count_if(missing)
    return report.groupBy(*by).agg(
        F.min("dq_date").alias("first_date"),
        F.max("dq_date").alias("last_date"),
        total.alias("total_days"),
        gaps.alias("missing_days"),
        F.count_if(missing & (F.col("day_type") == WEEKDAY)).alias("missing_weekdays"),
        F.count_if(missing & (F.col("day_type") == WEEKEND)).alias("missing_weekends"),
        F.when(total > 0, F.round((total - gaps) / total * 100, 2)).alias("coverage_pct"),
    )

"""Monthly summary per pair."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.functions.columns import run_stamp
from ratelake.schemas import PAIR


def monthly_summary(
    df: DataFrame, pair: Sequence[str] = PAIR, run_ts: datetime | str | None = None
) -> DataFrame:
    """Mean, range, sample deviation and count of the rate per pair and month.

    Partial aggregates run before the shuffle, so a pair with most of the rows
    costs no more than any other. Unsorted; sort where the result is read.
    """
    day = F.try_to_date(F.col("date"))
    rate = F.col("rate")
    return (
        df.groupBy(*pair, F.year(day).alias("year"), F.month(day).alias("month"))
        .agg(
            F.round(F.avg(rate), 4).alias("avg_rate"),
            F.min(rate).alias("min_rate"),
            F.max(rate).alias("max_rate"),
            F.round(F.coalesce(F.stddev_samp(rate), F.lit(0.0)), 4).alias("monthly_volatility"),
            F.count(rate).alias("observations_count"),
        )
        .withColumn("ingestion_timestamp", run_stamp(run_ts))
    )

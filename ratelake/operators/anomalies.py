"""Anomaly flags over rolling metrics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_anomalies(df: DataFrame, k: float = 2.0) -> DataFrame:
    """Add ``is_anomaly`` and ``z_score``; every row stays.

    A row is flagged when its rate is more than ``k`` rolling deviations away from
    the rolling mean. The row is part of its own frame, so with k = 2 the sixth row
    of a pair is the first that can be flagged.
    """
    spread = F.col("volatility_30d")
    distance = F.col("rate") - F.col("sma_30d")
    moves = F.coalesce(spread > 0, F.lit(False))
    return df.withColumns(
        {
            "is_anomaly": F.coalesce(moves & (F.abs(distance) > k * spread), F.lit(False)),
            "z_score": F.when(moves, F.round(distance / spread, 2)).otherwise(0.0),
        }
    )

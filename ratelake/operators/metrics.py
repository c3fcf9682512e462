"""Rolling metrics per pair: daily variation, moving averages, volatility."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelake.functions.columns import run_stamp
from ratelake.schemas import PAIR

SHORT_FRAME = 7
LONG_FRAME = 30
# Columns of a change row that say nothing about the rate.
_BOOKKEEPING = ("ingested_at", "row_hash", "operation_type", "ingestion_timestamp")


def calendar_year() -> Column:
    return F.substring("date", 1, 4)


def calendar_decade() -> Column:
    return F.substring("date", 1, 3)


def calendar_month() -> Column:
    return F.substring("date", 1, 7)


def rolling_metrics(
    df: DataFrame,
    pair: Sequence[str] = PAIR,
    run_ts: datetime | str | None = None,
    chunk: Column | None = None,
    tails: DataFrame | None = None,
) -> DataFrame:
    """Add daily_variation_pct, sma_7d, sma_30d and volatility_30d.

    The frames count rows of a pair in date order, not days; early rows use shorter
    frames. ``date`` is unique within a pair.

    A pair is not the unit of work, since one may hold much of the data. Its series
    is cut into chunks (``chunk``: an expression that never falls as the date rises;
    a decade by default, so at most 3,653 daily rows and less than 1 % of leads; the
    calendar year splits a dense pair further), and each chunk gets the
    rows that its first frames reach back to as a lead. The results are those of a
    window over the whole pair.

    ``tails``, if they are known, are these leads (see :func:`chunk_tails`): the rows
    before a chunk then need not be in ``df``, so that a single chunk can be computed.
    """
    series = df.drop(*_BOOKKEEPING).withColumn(
        "_chunk", calendar_decade() if chunk is None else chunk
    )
    if tails is None:
        tails = _tails(series, pair, LONG_FRAME - 1)
    lead = tails.select(*pair, "_chunk", F.explode("tail").alias("_row"))
    lead = lead.select(*pair, "_chunk", "_row.date", "_row.rate", F.lit(True).alias("_lead"))
    rows = series.withColumn("_lead", F.lit(False)).unionByName(lead, allowMissingColumns=True)

    ordered = Window.partitionBy(*pair, "_chunk").orderBy("date")
    short = ordered.rowsBetween(1 - SHORT_FRAME, 0)
    long = ordered.rowsBetween(1 - LONG_FRAME, 0)
    rate = F.col("rate")
    previous = F.col("_previous")
    return (
        rows.withColumns(
            {
                "_previous": F.lag("rate", 1).over(ordered),
                "sma_7d": F.avg(rate).over(short),
                "sma_30d": F.avg(rate).over(long),
                "volatility_30d": F.coalesce(F.stddev_samp(rate).over(long), F.lit(0.0)),
            }
        )
        .filter(~F.col("_lead"))
        .select(
            *[name for name in series.columns if name != "_chunk"],
            F.when(previous > 0, (rate - previous) / previous * 100)
            .otherwise(0.0)
            .alias("daily_variation_pct"),
            "sma_7d",
            "sma_30d",
            "volatility_30d",
            run_stamp(run_ts).alias("ingestion_timestamp"),
        )
    )


def chunk_tails(
    df: DataFrame, chunk: Column, pair: Sequence[str] = PAIR, reach: int = LONG_FRAME - 1
) -> DataFrame:
    """For each chunk of a pair, its ``tail``: the ``reach`` rows of the pair before it.

    An array of (date, rate) in date order, shorter where the pair has fewer rows, empty
    for its first chunk.
    """
    return _tails(df.withColumn("_chunk", chunk), pair, reach)


def _tails(series: DataFrame, pair: Sequence[str], reach: int) -> DataFrame:
    """The last rows of every chunk are found by a limited row number, which Spark
    applies before the shuffle as well. A chunk may hold fewer than ``reach`` rows,
    so a tail is taken from as many as ``reach`` earlier chunks: each has a row.
    """
    latest = F.row_number().over(Window.partitionBy(*pair, "_chunk").orderBy(F.desc("date")))
    ends = (
        series.select(*pair, "_chunk", "date", "rate")
        .withColumn("_nth", latest)
        .filter(F.col("_nth") <= reach)
        .groupBy(*pair, "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct("date", "rate"))).alias("_end"))
    )
    earlier = Window.partitionBy(*pair).orderBy("_chunk").rowsBetween(-reach, -1)
    before = F.flatten(F.collect_list("_end").over(earlier))
    return ends.select(*pair, "_chunk", before.alias("_before")).select(
        *pair, "_chunk", last_of("_before", reach).alias("tail")
    )


def last_of(array: str, count: int) -> Column:
    """The last elements of an array, all of them if it has no more."""
    return F.slice(array, F.greatest(F.size(array) - count + 1, F.lit(1)), count)

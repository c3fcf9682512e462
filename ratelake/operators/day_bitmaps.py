"""Which days a group has, as bitmaps: coverage without going over the rows again.

A bitmap holds a bit for each of 32,768 days, so one covers 89 years of a group in 4 KB.
Bitmaps of batches are merged by OR, summed up before the shuffle, and the coverage report
over all history reads the bitmaps alone. A day that no row has any more keeps its bit;
build the group's bitmaps anew from its rows where days can go.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.operators.coverage import coverage_report
from ratelake.schemas import PAIR

#: Days of a bitmap, as the bitmap functions have it, and the day before the first one:
#: ISO years 1 to 9999 are all after it, so that numbers of days are positive.
DAYS = 32768
_ORIGIN = 719163


def day_bitmaps(df: DataFrame, by: Sequence[str] = PAIR) -> DataFrame:
    """For each group and stretch of DAYS days a bitmap of the days its rows have.

    Null is a group like any other; text that is no date is ignored, and so are days
    outside the years 1 to 9999. Partial bitmaps are built before the shuffle.
    """
    day = F.unix_date(F.try_to_date(F.col("date"))) + F.lit(_ORIGIN)
    numbered = df.select(*by, day.cast("long").alias("_day")).filter(F.col("_day") > 0)
    stretch = F.bitmap_bucket_number("_day").alias("stretch")
    days = F.bitmap_construct_agg(F.bitmap_bit_position("_day")).alias("days")
    return numbered.groupBy(*by, stretch).agg(days)


def merge_bitmaps(
    stored: DataFrame, new: DataFrame, by: Sequence[str] = PAIR
) -> DataFrame:
    """The bitmaps of all days that either side has."""
    both = stored.select(*by, "stretch", "days").unionByName(new.select(*by, "stretch", "days"))
    return both.groupBy(*by, "stretch").agg(F.bitmap_or_agg("days").alias("days"))


def bitmap_days(bitmaps: DataFrame, by: Sequence[str] = PAIR) -> DataFrame:
    """One row for each group and day of the bitmaps, with the day as ``date``."""
    position = F.explode(F.filter(F.sequence(F.lit(0), F.lit(DAYS - 1)), _has_bit)).alias("_at")
    first = ((F.col("stretch") - 1) * DAYS + 1 - _ORIGIN).cast("int")
    found = bitmaps.select(*by, position, first.alias("_first"))
    return found.select(*by, F.date_from_unix_date(F.col("_first") + F.col("_at")).alias("date"))


def _has_bit(position: Column) -> Column:
    byte = F.substring(F.col("days"), F.shiftright(position, 3) + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), position % 8) == 1


def coverage_from_bitmaps(
    bitmaps: DataFrame, by: Sequence[str] = (), run_ts: datetime | str | None = None
) -> DataFrame:
    """The rows that ``coverage_report`` gives for the rows that the bitmaps were built of.

    ``by`` may leave out groups of the bitmaps: a day counts that any of them has.
    """
    named = list(by)
    merged = bitmaps.groupBy(*named, "stretch").agg(F.bitmap_or_agg("days").alias("days"))
    return coverage_report(bitmap_days(merged, named), by=named, run_ts=run_ts)


def days_covered(bitmaps: DataFrame, by: Sequence[str] = PAIR) -> DataFrame:
    """How many days each group has: set bits, counted without unpacking."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("days")).alias("days"))

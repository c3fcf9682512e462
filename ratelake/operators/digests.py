"""Digests of a pair's month, and change detection that reads only months that differ.

A digest is the count of a month's rows and four sums of two 64-bit hashes of key and
value: 128 bits that do not depend on the order of the rows and that partial aggregates
sum up before the shuffle. Two months with equal digests hold the same keys and values,
but for a chance of hash collision; :func:`detect_changes` alone compares every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.functions.columns import month_number, plain_text, row_text
from ratelake.operators.changes import detect_changes
from ratelake.operators.clean import in_range
from ratelake.operators.merge import live_rows
from ratelake.schemas import KEYS, PAIR

CELL = (*PAIR, "year", "month")
_SUMS = ("n", "a_high", "a_low", "b_high", "b_low")
Month = tuple[int, int]


def month_digests(
    rows: DataFrame, as_text: Callable[[Column], Column] = plain_text
) -> DataFrame:
    """One row for each pair and month: n and the sums of the hashes of its rows.

    ``rows`` have the key columns, ``rate`` and the month's columns ``year`` and ``month``.
    """
    text = row_text(("rate",), "", as_text)
    sums = [F.count("*").alias("n")]
    for name, seed in (("a", 11), ("b", 1213)):
        hashed = F.xxhash64(*KEYS, text, F.lit(seed))
        # In halves: the sum of a month's 64-bit hashes would not fit 64 bits.
        sums.append(F.sum(F.shiftright(hashed, 32)).alias(f"{name}_high"))
        sums.append(F.sum(hashed.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_low"))
    return rows.groupBy(*CELL).agg(*sums)


def stored_digests(
    rows: DataFrame, as_text: Callable[[Column], Column] = plain_text
) -> DataFrame:
    """The digests to keep beside a base table: of all its rows (``live`` false), and of
    those that are not soft-deleted (``live`` true), for either treatment of tombstones.
    """
    everything = month_digests(rows, as_text).withColumn("live", F.lit(False))
    living = month_digests(live_rows(rows), as_text).withColumn("live", F.lit(True))
    return everything.unionByName(living)


def whole_months(lo: str, hi: str) -> tuple[int, int]:
    """The first and last month number that lie in [lo, hi] with all their days; the last
    is below the first if there is none."""
    first, last = date.fromisoformat(lo), date.fromisoformat(hi) + timedelta(days=1)
    low = first.year * 12 + first.month - 1 + (first.day > 1)
    return low, last.year * 12 + last.month - 2


def differing_cells(
    incoming: DataFrame,
    digests: DataFrame,
    lo: str,
    hi: str,
    tombstones: str = "latched",
    in_doubt: Iterable[Month] = (),
    as_text: Callable[[Column], Column] = plain_text,
) -> DataFrame:
    """The months of pairs that may hold a change, of those that [lo, hi] touches.

    A month that the range covers in part, or whose stored digest is ``in_doubt``, always
    counts, for every pair that has rows on either side.
    """
    low, high = whole_months(lo, hi)
    number = month_number("year", "month")
    doubt = F.lit(False)
    for year, month in in_doubt:
        doubt = doubt | (number == year * 12 + month - 1)
    ends = [date.fromisoformat(end) for end in (lo, hi)]
    touched = number.between(*(day.year * 12 + day.month - 1 for day in ends))
    known = digests.filter(F.col("live") == F.lit(tombstones == "strict")).filter(touched)
    known = known.select(*CELL, F.struct(*_SUMS).alias("stored"))
    new = month_digests(in_range(incoming, lo, hi), as_text)
    new = new.select(*CELL, F.struct(*_SUMS).alias("found"))
    comparable = number.between(low, high) & ~doubt
    same = comparable & F.coalesce(F.col("found") == F.col("stored"), F.lit(False))
    return new.join(known, [*CELL], "full").filter(~same).select(*CELL)


def detect_changes_by_digest(
    incoming: DataFrame,
    target: DataFrame,
    cells: DataFrame,
    months: Iterable[Month],
    *,
    lo: str,
    hi: str,
    run_ts: datetime | str | None = None,
    tombstones: str = "latched",
    as_text: Callable[[Column], Column] = plain_text,
) -> DataFrame:
    """The rows that :func:`detect_changes` gives, from the differing cells alone.

    ``cells`` are those of :func:`differing_cells`, ``months`` their months: of the target
    only these partitions are read, and only the cells' rows enter the join. Both sides
    have the columns ``year`` and ``month``.
    """
    chosen = F.lit(False)
    for year, month in months:
        chosen = chosen | ((F.col("year") == year) & (F.col("month") == month))
    sides = [
        side.filter(chosen).join(cells, [*CELL], "left_semi") for side in (incoming, target)
    ]
    return detect_changes(
        *sides, lo=lo, hi=hi, run_ts=run_ts, tombstones=tombstones, as_text=as_text
    )

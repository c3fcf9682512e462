"""Monthly summaries that are merged instead of computed again.

A month of a pair is kept as count, mean, sum of squared deviations from the mean, least
and greatest rate. Two such states merge into that of all their rows, so a batch of
inserts needs no stored row: its own states are merged with the stored ones. A month with
an update or a delete is computed again from its rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.functions.columns import run_stamp
from ratelake.schemas import INSERT, PAIR

STATE = ("n", "mean", "squares", "least", "greatest")


def monthly_moments(df: DataFrame, pair: Sequence[str] = PAIR) -> DataFrame:
    """The state of each pair and month; partial aggregates run before the shuffle."""
    day = F.try_to_date(F.col("date"))
    rate = F.col("rate")
    return df.groupBy(*pair, F.year(day).alias("year"), F.month(day).alias("month")).agg(
        F.count(rate).alias("n"),
        F.avg(rate).alias("mean"),
        (F.var_pop(rate) * F.count(rate)).alias("squares"),
        F.min(rate).alias("least"),
        F.max(rate).alias("greatest"),
    )


def merge_moments(stored: DataFrame, new: DataFrame, pair: Sequence[str] = PAIR) -> DataFrame:
    """The states of the rows of both sides, which hold different rows.

    Squared deviations are taken from the common mean, so nothing is lost where the mean
    is large beside the deviations. A month that only one side has stays as it is.
    """
    cell = [*pair, "year", "month"]
    left = stored.select(*cell, F.struct(*STATE).alias("s"))
    right = new.select(F.struct(*cell).alias("of"), F.struct(*STATE).alias("t"))
    n = F.col("s.n") + F.col("t.n")
    apart = F.col("t.mean") - F.col("s.mean")
    # A side without rates has no mean; the other is the whole.
    s_empty = F.col("s").isNull() | (F.col("s.n") == 0)
    t_empty = F.col("t").isNull() | (F.col("t.n") == 0)
    merged = {
        "n": n,
        "mean": F.col("s.mean") + apart * F.col("t.n") / n,
        "squares": F.col("s.squares")
        + F.col("t.squares")
        + apart * apart * F.col("s.n") * F.col("t.n") / n,
        "least": F.least("s.least", "t.least"),
        "greatest": F.greatest("s.greatest", "t.greatest"),
    }

    def value(name: str) -> Column:
        one_side = F.when(t_empty, F.coalesce(f"s.{name}", f"t.{name}")).when(s_empty, F.col(f"t.{name}"))
        return one_side.otherwise(merged[name]).alias(name)

    # Null is a group like any other; a month of the right side alone has no column of the left.
    of = [F.when(F.col("s").isNull(), F.col(f"of.{c}")).otherwise(F.col(c)).alias(c) for c in cell]
    both = left.join(right, _same(cell), "full")
    return both.select(*of, *(value(name) for name in STATE))


def _same(cell: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"of.{c}")) for c in cell])


def summary_of(states: DataFrame, run_ts: datetime | str | None = None) -> DataFrame:
    """The rows that ``monthly_summary`` gives for the rows of the states."""
    n = F.col("n")
    deviation = F.when(n > 1, F.sqrt(F.greatest(F.col("squares"), F.lit(0.0)) / (n - 1)))
    return states.select(
        *[name for name in states.columns if name not in STATE],
        F.round("mean", 4).alias("avg_rate"),
        F.col("least").alias("min_rate"),
        F.col("greatest").alias("max_rate"),
        F.round(F.coalesce(deviation, F.lit(0.0)), 4).alias("monthly_volatility"),
        n.alias("observations_count"),
        run_stamp(run_ts).alias("ingestion_timestamp"),
    )


def updated_moments(
    stored: DataFrame, changes: DataFrame, live: DataFrame, pair: Sequence[str] = PAIR
) -> DataFrame:
    """The states after a batch: ``stored`` before it, its (staged) ``changes`` and the
    ``live`` rows after it. States, changes and rows have the columns ``year`` and ``month``.

    Months with inserts alone are merged and read no live row; those with an update or a
    delete are computed again, and go if they have no row left. INSERTs here are new rows,
    not tombstones that come back, which change detection reports for ``"strict"`` only
    where the stored state has no such row either.
    """
    cell = [*pair, "year", "month"]
    kinds = changes.groupBy(*cell).agg(
        F.bool_and(F.col("operation_type") == INSERT).alias("inserts_alone")
    )
    again = kinds.filter(~F.col("inserts_alone")).select(F.struct(*cell).alias("of"))
    # At most twelve values for each calendar year; without any, no live row is read.
    months = [tuple(row) for row in again.select("of.year", "of.month").distinct().collect()]
    if not months:
        return merge_moments(stored, monthly_moments(changes.select(*pair, "date", "rate"), pair), pair)
    new = changes.join(again, _same(cell), "left_anti")
    kept = stored.join(again, _same(cell), "left_anti")
    chosen = reduce(or_, [(F.col("year") == y) & (F.col("month") == m) for y, m in months])
    rows = live.filter(chosen).join(again, _same(cell), "left_semi")
    computed = monthly_moments(rows.select(*pair, "date", "rate"), pair)
    merged = merge_moments(kept, monthly_moments(new.select(*pair, "date", "rate"), pair), pair)
    return merged.unionByName(computed)

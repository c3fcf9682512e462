"""State that is merged instead of computed again: day bitmaps, moments, digests."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ratelake.operators import (
    bitmap_days,
    coverage_from_bitmaps,
    coverage_report,
    day_bitmaps,
    days_covered,
    merge_bitmaps,
    merge_moments,
    month_digests,
    monthly_moments,
    monthly_summary,
    summary_of,
    updated_moments,
)
from ratelake.operators.digests import whole_months
from ratelake.sources.tables import with_month

PAIR_ROWS = "base string, target string, date string, rate double"


def rows(df, *names):
    key = lambda row: tuple(map(str, row))
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)


def random_rows(seed, count):
    draw = random.Random(seed)
    first = date(1969, 11, 20)
    return [
        (
            draw.choice(["USD", None]),
            draw.choice("ABC"),
            (first + timedelta(days=draw.randrange(400))).isoformat(),
            draw.uniform(1, 3),
        )
        for _ in range(count)
    ]


def test_bitmaps_hold_the_days(spark):
    """Days before and after the epoch, both ends of the calendar, two stretches, no dates."""
    days = ["0001-01-01", "1969-12-31", "1970-01-01", "1970-01-02", "2026-05-06", "9999-12-31"]
    df = spark.createDataFrame(
        [("USD", "A", d, 1.0) for d in days + days + ["no date", None]] + [(None, "B", days[3], 1.0)], PAIR_ROWS
    )
    found = rows(bitmap_days(day_bitmaps(df)), "base", "target", "date")
    assert [(b, t, d.isoformat()) for b, t, d in found if b] == [("USD", "A", d) for d in days]
    assert [(b, t, d.isoformat()) for b, t, d in found if not b] == [(None, "B", days[3])]
    assert rows(days_covered(day_bitmaps(df)), "target", "days") == [("A", 6), ("B", 1)]


def test_merged_bitmaps_give_the_report(spark):
    first, second = (spark.createDataFrame(random_rows(s, 150), PAIR_ROWS) for s in (1, 2))
    merged = merge_bitmaps(day_bitmaps(first), day_bitmaps(second))
    both = first.unionByName(second)
    for by in ((), ("target",), ("base", "target")):
        names = [*by, "dq_date", "day_type", "status_detail", "is_missing"]
        got, want = coverage_from_bitmaps(merged, by=by), coverage_report(both, by=by)
        assert rows(got, *names) == rows(want, *names)
    none = day_bitmaps(first.limit(0))
    assert coverage_from_bitmaps(none).count() == 0
    assert merge_bitmaps(none, day_bitmaps(first)).count() == day_bitmaps(first).count()


def test_merged_moments_are_those_of_all_rows(spark):
    """Several batches, months of one side only, null rates, a large mean."""
    parts = [random_rows(seed, 120) for seed in (3, 4, 5)]
    parts[2] = [(b, "C", d, 1e9 + r) for b, _, d, r in parts[2]]
    parts[1] += [("USD", "N", "2026-05-06", None)]
    frames = [spark.createDataFrame(part, PAIR_ROWS) for part in parts]
    states, whole = monthly_moments(frames[0].limit(0)), frames[0].limit(0)
    for frame in frames:
        states, whole = merge_moments(states, monthly_moments(frame)), whole.unionByName(frame)
    names = ["base", "target", "year", "month", "observations_count", "min_rate", "max_rate"]
    got, want = summary_of(states), monthly_summary(whole)
    assert rows(got, *names) == rows(want, *names)
    close = ["base", "target", "year", "month", "avg_rate", "monthly_volatility"]
    for one, other in zip(rows(got, *close), rows(want, *close), strict=True):
        assert one[:4] == other[:4]
        assert one[4] == pytest.approx(other[4], abs=1e-4, nan_ok=True)
        assert one[5] == pytest.approx(other[5], abs=1e-4)


def change_rows(spark, changes):
    return with_month(spark.createDataFrame(changes, f"{PAIR_ROWS}, operation_type string"))


def test_inserts_read_no_stored_row(spark):
    """A batch of inserts: the plan has no live row; an update reads its month alone."""
    stored = spark.createDataFrame(
        [("USD", "A", f"2026-0{m}-0{d}", float(m * d)) for m in (4, 5) for d in (1, 2, 3)], PAIR_ROWS
    )
    states = monthly_moments(stored)
    poison = F.raise_error(F.lit("a live row was read")).cast("double")
    live = with_month(stored).withColumn("rate", poison)
    inserts = [("USD", "A", "2026-05-09", 7.0, "INSERT"), ("USD", "B", "2026-05-09", 8.0, "INSERT")]
    after = updated_moments(states, change_rows(spark, inserts), live)
    whole = stored.unionByName(change_rows(spark, inserts).select(*stored.columns))
    names = ["target", "month", "avg_rate", "monthly_volatility", "observations_count"]
    assert rows(summary_of(after), *names) == rows(monthly_summary(whole), *names)

    update = [("USD", "A", "2026-05-02", 9.0, "UPDATE"), ("USD", "A", "2026-04-09", 1.0, "INSERT")]
    new = stored.withColumn("rate", F.when(F.col("date") == "2026-05-02", 9.0).otherwise(F.col("rate")))
    live = with_month(new).withColumn("rate", F.when(F.col("month") == 4, poison).otherwise(F.col("rate")))
    after = updated_moments(states, change_rows(spark, update), live)
    whole = new.unionByName(change_rows(spark, update[1:]).select(*stored.columns))
    assert rows(summary_of(after), *names) == rows(monthly_summary(whole), *names)


def test_a_month_without_rows_goes(spark):
    stored = spark.createDataFrame([("USD", "A", "2026-05-06", 1.0)], PAIR_ROWS)
    gone = change_rows(spark, [("USD", "A", "2026-05-06", 1.0, "DELETE")])
    after = updated_moments(monthly_moments(stored), gone, with_month(stored.limit(0)))
    assert after.count() == 0


def test_digests_differ_with_any_row(spark):
    """Order does not matter; a key, a value, a null or a missing row does."""
    base = [("USD", "A", f"2026-05-0{d}", d / 3) for d in range(1, 6)]

    def digest(some):
        return rows(month_digests(with_month(spark.createDataFrame(some, PAIR_ROWS))), "n", "a_high", "a_low", "b_high", "b_low")

    same = digest(base)
    assert digest(base[::-1]) == same
    others = [base[1:], [*base[:-1], ("USD", "A", "2026-05-05", 1.5)], [*base[:-1], ("USD", "A", "2026-05-05", None)]]
    others.append([*base[:-1], ("USD", "A", "2026-05-06", 5 / 3)])
    # Values that change places.
    others.append([("USD", "A", "2026-05-01", 2 / 3), ("USD", "A", "2026-05-02", 1 / 3), *base[2:]])
    assert all(digest(some) != same for some in others)


def test_months_that_a_range_covers_whole():
    number = lambda year, month: year * 12 + month - 1
    assert whole_months("2026-01-01", "2026-03-31") == (number(2026, 1), number(2026, 3))
    assert whole_months("2026-01-02", "2026-03-30") == (number(2026, 2), number(2026, 2))
    low, high = whole_months("2026-05-02", "2026-05-30")
    assert high < low
    assert whole_months("2025-12-01", "2026-02-28") == (number(2025, 12), number(2026, 2))

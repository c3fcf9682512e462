"""Cleaning: complete rows, plausible rates, one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelake.functions.columns import month_number
from ratelake.schemas import KEYS

# The accepted rates, both ends included.
RATE_MIN = 0.00001
RATE_MAX = 500000.0


def clean_rates(
    df: DataFrame,
    lo: float = RATE_MIN,
    hi: float = RATE_MAX,
    keys: Sequence[str] = KEYS,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Rows with all keys and a rate in [lo, hi]; the first per key survives.

    "First" is by ``tie_break`` (a leading "-" turns a column's order round), then by
    every other column that has an order, so the survivor does not depend on how the
    input is split. Spark turns ``row_number() = 1`` into a group limit that runs before
    the shuffle too (WindowGroupLimit), so a key that holds a large share of the rows
    leaves each map task as a single row.
    """
    valid = df.na.drop(subset=[*keys, "rate"]).filter(F.col("rate").between(lo, hi))
    named = {*keys, *(tie.lstrip("-") for tie in tie_break)}
    rest = [
        name
        for name, kind in df.dtypes
        if name not in named and "map<" not in kind and "variant" not in kind
    ]
    ties = [F.desc(tie[1:]) if tie.startswith("-") else F.asc(tie) for tie in tie_break]
    order = [*ties, *rest] or list(keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return valid.withColumn("_rank", first).filter("_rank = 1").drop("_rank")


def drop_report(
    df: DataFrame,
    lo: float = RATE_MIN,
    hi: float = RATE_MAX,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """How many rows each rule of :func:`clean_rates` takes out, one row per rule.

    Rejected rows are counted under a null key, and duplicates are counted per key
    before the shuffle, so no group is larger than one row per map task.
    """
    incomplete = reduce(or_, [F.col(name).isNull() for name in [*keys, "rate"]])
    rule = (
        F.when(incomplete, "missing field")
        .when(~F.col("rate").between(lo, hi), "rate out of range")
        .otherwise("valid")
    )
    per_key = (
        df.select(rule.alias("rule"), *keys)
        .select("rule", *[F.when(F.col("rule") == "valid", F.col(k)).alias(k) for k in keys])
        .groupBy("rule", *keys)
        .agg(F.count("*").alias("n"))
    )

    def total(rule_name: str, amount: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("rule") == rule_name, amount)), F.lit(0).cast("long"))

    n = F.col("n")
    one = F.lit(1).cast("long")
    totals = per_key.agg(
        total("missing field", n).alias("missing"),
        total("rate out of range", n).alias("out_of_range"),
        total("valid", n - 1).alias("duplicate"),
        total("valid", one).alias("kept"),
    )
    return totals.selectExpr(
        "stack(4, 'missing field', missing, 'rate out of range', out_of_range,"
        " 'duplicate key', duplicate, 'kept', kept) as (rule, row_count)"
    )


def valid_days(df: DataFrame) -> DataFrame:
    """Rows whose date is the ISO text of a day of the calendar."""
    return df.filter(F.try_to_date(F.col("date")).cast("string") == F.col("date"))


def in_range(df: DataFrame, lo: str | None, hi: str | None) -> DataFrame:
    """Rows with lo <= date <= hi, both ISO text; either bound may be None.

    ISO dates order as text, so the comparison reaches the parquet scan. On a table
    partitioned by (year, month) the bounds also select the partitions to read.
    """
    partitioned = {"year", "month"} <= set(df.columns)
    first = date.fromisoformat(lo) if lo is not None else date.min
    last = date.fromisoformat(hi) if hi is not None else date.max
    if lo is not None:
        df = df.filter(F.col("date") >= first.isoformat())
    if hi is not None:
        df = df.filter(F.col("date") <= last.isoformat())
    if partitioned and (lo is not None or hi is not None):
        months = [month_number(F.lit(day.year), F.lit(day.month)) for day in (first, last)]
        df = df.filter(
            F.col("year").between(first.year, last.year)
            & month_number("year", "month").between(*months)
        )
    return df

"""Column expressions used by more than one operator. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def run_stamp(run_ts: datetime | str | None) -> Column:
    """The time of the run: a literal when given, so that results can be repeated."""
    if run_ts is None:
        return F.current_timestamp()
    return F.lit(run_ts).cast("timestamp")


def plain_text(value: Column) -> Column:
    return value.cast("string")


def row_text(
    names: Sequence[str],
    prefix: str = "",
    as_text: Callable[[Column], Column] = plain_text,
) -> Column:
    """The text that stands for a row when two versions of it are compared.

    One column gives its own text, with '' for null. Several give a JSON object
    with its nulls kept, so that neither a null nor a separator inside a value
    can make two different rows look the same.
    """
    if len(names) == 1:
        return F.coalesce(as_text(F.col(prefix + names[0])), F.lit(""))
    fields = [as_text(F.col(prefix + name)).alias(name) for name in names]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def iso_millis(stamp: Column) -> Column:
    """ISO-8601 UTC text with milliseconds, whatever the session time zone.

    Counted from the epoch: the session's wall clock has gaps and overlaps, in which a
    UTC time has no text of its own.
    """
    micros = F.unix_micros(stamp)
    since = F.make_dt_interval(secs=(micros.cast("decimal(24,0)") / 1000000).cast("decimal(18,6)"))
    text = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since).cast("string")
    millis = F.lpad(F.pmod(F.floor(micros / 1000), F.lit(1000)).cast("string"), 3, "0")
    return F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("."), millis, F.lit("Z")
    )


def month_number(year: Column | str, month: Column | str) -> Column:
    """Months counted on one axis, so that a range of months is one comparison."""
    year = F.col(year) if isinstance(year, str) else year
    month = F.col(month) if isinstance(month, str) else month
    return year * 12 + month - 1

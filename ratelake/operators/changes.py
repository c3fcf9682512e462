"""Change detection between an incoming batch and the stored rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.functions.columns import plain_text, row_text, run_stamp
from ratelake.operators.clean import in_range
from ratelake.schemas import CHANGES, DELETE, INSERT, KEYS, UPDATE

_STORED = "stored_"
# Values taken from the incoming row, or from the stored row where there is none.
_CARRIED = ("base_amount", "rate", "ingested_at")


def detect_changes(
    incoming: DataFrame,
    target: DataFrame | None = None,
    *,
    keys: Sequence[str] = KEYS,
    hash_cols: Sequence[str] = ("rate",),
    lo: str | None = None,
    hi: str | None = None,
    run_ts: datetime | str | None = None,
    tombstones: str = "latched",
    as_text: Callable[[Column], Column] = plain_text,
) -> DataFrame:
    """INSERT, UPDATE and DELETE rows that turn ``target`` into ``incoming``.

    ``target=None`` means there is no table yet: every row is an INSERT. Both sides
    are cut to [lo, hi] before the join, since a filter on the joined date cannot
    pass a full outer join. Both sides hold one row per key (``clean_rates`` and
    ``merge_changes`` see to it), so no join key is large on either side.

    ``tombstones="latched"`` compares with soft-deleted rows as with any other: an
    absent one is a DELETE again, and one that returns with the same value is no
    change. ``"strict"`` leaves them out: no second DELETE, and a return is an INSERT.

    Rows are compared by the text that is hashed, and only change rows are hashed:
    most rows of a slice do not change, and the stored hash need not be read.
    """
    if tombstones not in ("latched", "strict"):
        raise ValueError(f"tombstones must be 'latched' or 'strict', not {tombstones!r}")
    carried = list(dict.fromkeys([*keys, *_CARRIED, *hash_cols]))
    new = in_range(incoming, lo, hi).select(*carried)
    stamp = run_stamp(run_ts)

    if target is None:
        return _change_rows(new, F.lit(INSERT), row_text(hash_cols, "", as_text), stamp)

    stored = in_range(target, lo, hi)
    if tombstones == "strict":
        stored = stored.filter(F.col("operation_type") != DELETE)
    stored = stored.select(*[F.col(name).alias(_STORED + name) for name in carried])

    same_key = reduce(and_, [F.col(key) == F.col(_STORED + key) for key in keys])
    new_text = row_text(hash_cols, "", as_text)
    stored_text = row_text(hash_cols, _STORED, as_text)
    is_new = F.col(_STORED + keys[0]).isNull()
    is_gone = F.col(keys[0]).isNull()
    changed = (
        new.join(stored, same_key, "full")
        .withColumn(
            "operation_type",
            F.when(is_new, INSERT)
            .when(is_gone, DELETE)
            .when(new_text != stored_text, UPDATE),
        )
        .withColumn("_text", F.when(is_gone, stored_text).otherwise(new_text))
        .filter(F.col("operation_type").isNotNull())
        .select(
            *[F.coalesce(F.col(name), F.col(_STORED + name)).alias(name) for name in carried],
            "operation_type",
            "_text",
        )
    )
    return _change_rows(changed, F.col("operation_type"), F.col("_text"), stamp)


def _change_rows(df: DataFrame, operation: Column, text: Column, stamp: Column) -> DataFrame:
    computed = {
        "row_hash": F.sha2(text, 256),
        "operation_type": operation,
        "ingestion_timestamp": stamp,
        "updated_at": stamp,
    }
    return df.select(
        *[computed.get(name, F.col(name)).alias(name) for name in CHANGES.fieldNames()]
    )


def delete_gate(changes: DataFrame) -> DataFrame:
    """One row: whether the batch holds a DELETE, and how many."""
    deletes = F.count_if(F.col("operation_type") == DELETE)
    return changes.agg((deletes > 0).alias("has_deletes"), deletes.alias("delete_count"))


def has_deletes(changes: DataFrame) -> bool:
    """Whether any row is a DELETE; stops at the first one found."""
    return not changes.filter(F.col("operation_type") == DELETE).isEmpty()

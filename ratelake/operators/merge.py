"""Applying change rows to the stored rows: upsert with soft delete."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratelake.schemas import CHANGES, DELETE, INSERT, KEYS, UPDATE

# What a matched change may overwrite. The first ingest stamps are kept.
UPDATED_BY_UPDATE = ("base_amount", "rate", "row_hash", "operation_type", "updated_at")
UPDATED_BY_DELETE = ("operation_type", "updated_at")
_CHANGE = "change_"


def merge_changes(
    target: DataFrame,
    changes: DataFrame,
    keys: Sequence[str] = KEYS,
    revive: bool = False,
) -> DataFrame:
    """The stored rows after the changes; the columns are those of the base table.

    An unmatched change is inserted whatever its operation. A matched UPDATE sets
    value, hash, operation and ``updated_at``; a matched DELETE sets only operation
    and ``updated_at``; a matched INSERT changes nothing, except with ``revive``
    (for ``tombstones="strict"``), where it replaces a soft-deleted row.

    Two changes for one key raise an error. That check moves the changes alone.
    """
    columns = CHANGES.fieldNames()
    change = changes.select(*[F.col(name).alias(_CHANGE + name) for name in columns])
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    single = F.assert_true(F.col("_nth") == 1, F.lit("more than one change for one key"))
    checked = (
        changes.select(*columns, nth.alias("_nth"))
        .filter(single.isNull())
        .select(*[F.col(name).alias(_CHANGE + name) for name in columns])
    )

    same_key = reduce(and_, [F.col(key) == F.col(_CHANGE + key) for key in keys])
    stored = target.select(*columns)
    # The changes are the side that Spark may broadcast by its size in every join here,
    # so that a few changes move no stored row; many are shuffled.
    joined = stored.join(change, same_key, "left")
    change_keys = change.select(*[_CHANGE + key for key in keys])
    held = stored.select(*keys).join(change_keys, same_key, "left_semi")
    # The inserts go over all changes, so the check for a second change is made there.
    new = checked.join(held, same_key, "left_anti")

    operation = F.col(_CHANGE + "operation_type")
    replaced_whole = F.lit(False)
    if revive:
        replaced_whole = (operation == INSERT) & (F.col("operation_type") == DELETE)

    def merged(name: str):
        replaced = replaced_whole
        if name in UPDATED_BY_UPDATE:
            replaced = replaced | (operation == UPDATE)
        if name in UPDATED_BY_DELETE:
            replaced = replaced | (operation == DELETE)
        return F.when(replaced, F.col(_CHANGE + name)).otherwise(F.col(name)).alias(name)

    inserted = new.select(*[F.col(_CHANGE + name).alias(name) for name in columns])
    return joined.select(*[merged(name) for name in columns]).unionByName(inserted)


def live_rows(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(F.col("operation_type") != DELETE)

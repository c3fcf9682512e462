"""Catalog tables: existence, scan, and the load modes.

Tables are parquet, partitioned by (year, month). A month is replaced by writing its new
version beside the old one and then pointing the catalog's partition at it, in one catalog
operation: a reader sees the old month or the new one, never a part and never none, and a
driver lost on the way leaves every month readable. Old versions stay for readers that
have begun with them, until :func:`sweep_versions` removes them by age. Several months are
not replaced in one moment; where that is needed, use a transactional table format with
:func:`merge_into` for the base table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators.changes import has_deletes
from ratelake.operators.merge import UPDATED_BY_DELETE, UPDATED_BY_UPDATE, merge_changes
from ratelake.schemas import CHANGES, DELETE, INSERT, KEYS, PAIR, UPDATE
from ratelake.sources.shared import folders_older_than, remove_folder, staged

PARTITIONS = ("year", "month")
MODES = ("append", "merge_cdc", "overwrite_partitions")
DERIVED, DIGESTS = "months", "digests"
_SCOPE = "ratelake.scope"
_UNPUBLISHED = "ratelake.unpublished"
#: Folder of a table in which new versions of its months are written; no scan lists it.
_VERSIONS = "_versions"
#: Rows of a parquet page: rows are sorted by pair, and a scan for a few pairs skips pages.
_PAGE_ROWS = "4000"

Month = tuple[int, int]


def with_month(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Add the partition columns, unless the rows have them already."""
    if set(PARTITIONS) <= set(df.columns):
        return df
    day = F.try_to_date(F.col(date_col).cast("string"))
    return df.withColumns({"year": F.year(day), "month": F.month(day)})


def is_month(months: Iterable[Month]) -> Column:
    """Whether (year, month) is one of ``months``, as a test on the two columns."""
    by_year: dict[int, list[int]] = {}
    for year, month in months:
        by_year.setdefault(year, []).append(month)
    chosen = F.lit(False)
    for year, in_year in sorted(by_year.items()):
        chosen = chosen | ((F.col("year") == year) & F.col("month").isin(sorted(in_year)))
    return chosen


def in_months(df: DataFrame, months: Iterable[Month]) -> DataFrame:
    """Rows of these months; on a partitioned table only their partitions are read."""
    return df.filter(is_month(months))


def load(
    df: DataFrame,
    table: str,
    mode: str = "append",
    partition_by: Sequence[str] = PARTITIONS,
    date_col: str = "date",
    revive: bool = False,
) -> tuple[DataFrame, bool]:
    """Load rows into a table; returns a fresh scan and whether a DELETE was merged.

    A table that does not exist is created, whatever the mode. ``merge_cdc`` takes
    change rows and rewrites the months that they touch. It goes over the changes
    twice, and they must not depend on the table: pass them ``staged``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    spark = df.sparkSession
    merges = mode == "merge_cdc"
    if set(PARTITIONS) & set(partition_by):
        df = with_month(df, date_col)
    deletes = False
    if not spark.catalog.tableExists(table):
        writer = _spread(df, partition_by).write.format("parquet").options(**_written())
        writer.partitionBy(*partition_by).saveAsTable(table)
        deletes = merges and has_deletes(spark.table(table))
    elif merges:
        deletes = _merge(df, table, partition_by, date_col, revive)
    elif mode == "overwrite_partitions":
        stored = {c.name for c in spark.catalog.listColumns(table) if c.isPartition}
        if stored != set(partition_by):
            raise ValueError(f"{table} is partitioned by {sorted(stored)}, not {partition_by}")
        _replace_partitions(df, table, partition_by)
    else:
        _in_table_order(_spread(df, partition_by), table).write.insertInto(table)
    spark.catalog.refreshTable(table)
    return spark.table(table), deletes


def months_of(df: DataFrame) -> list[Month]:
    """The distinct months of a relation: at most twelve values per calendar year."""
    found = df.select(*PARTITIONS).distinct().filter("year is not null").collect()
    return sorted((row.year, row.month) for row in found)


def touched_months(changes: DataFrame) -> tuple[list[Month], bool]:
    """The months of change rows, and whether any row is a DELETE, in one job."""
    found = (
        changes.groupBy(*PARTITIONS)
        .agg(F.max(F.col("operation_type") == DELETE).alias("deletes"))
        .collect()
    )
    if any(row.year is None for row in found):
        raise ValueError("change rows need a date that is an ISO day")
    return sorted((row.year, row.month) for row in found), any(row.deletes for row in found)


def drop_months(spark: SparkSession, table: str, months: Iterable[Month]) -> None:
    """Drop partitions. Replacing partitions can never empty one; this does."""
    gone = [f"PARTITION (year = {int(y)}, month = {int(m)})" for y, m in sorted(months)]
    if gone:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(gone)}")


def note_pending(
    spark: SparkSession, table: str, months: Iterable[Month], of: str = DERIVED
) -> None:
    """Note on a table the months that other tables have yet to follow: the DERIVED ones,
    or its DIGESTS.

    Runs of months are noted by their ends, as metastores limit a property's length.
    """
    runs: list[list[int]] = []
    for number in sorted(year * 12 + month - 1 for year, month in months):
        if runs and number == runs[-1][1] + 1:
            runs[-1][1] = number
        else:
            runs.append([number, number])
    _note(spark, table, f"ratelake.pending_{of}", ",".join(f"{first}:{last}" for first, last in runs))


def _note(spark: SparkSession, table: str, key: str, text: str) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({_text(key)} = {_text(text)})")


def _noted(spark: SparkSession, table: str, key: str) -> str:
    properties = spark.sql(f"SHOW TBLPROPERTIES {table}").filter(F.col("key") == key)
    return "".join(row.value for row in properties.collect())


def keep_scope(spark: SparkSession, table: str, scope: str) -> None:
    """Note the scope of a set of tables at first, and refuse another one later."""
    noted = _noted(spark, table, _SCOPE)
    if noted and noted != scope:
        raise ValueError(f"the tables of {table} were made with scope {noted!r}, not {scope!r}")
    if not noted:
        _note(spark, table, _SCOPE, scope)


def note_unpublished(spark: SparkSession, table: str, parts: dict[str, list[str]]) -> None:
    """Note the staged folders whose rows of a kind are yet to be published."""
    _note(spark, table, _UNPUBLISHED, json.dumps({k: v for k, v in sorted(parts.items()) if v}))


def unpublished(spark: SparkSession, table: str) -> dict[str, list[str]]:
    """What :func:`note_unpublished` noted."""
    return json.loads(_noted(spark, table, _UNPUBLISHED) or "{}")


def pending_months(spark: SparkSession, table: str, of: str = DERIVED) -> list[Month]:
    """The months noted by :func:`note_pending`."""
    text = _noted(spark, table, f"ratelake.pending_{of}")
    runs = [[int(end) for end in run.split(":")] for run in text.split(",") if run]
    numbers = [number for first, last in runs for number in range(first, last + 1)]
    return [(number // 12, number % 12 + 1) for number in numbers]


def merge_into(changes: DataFrame, table: str, view: str = "change", revive: bool = False) -> None:
    """The same merge by the catalog's own MERGE, for transactional table formats."""
    target = table.split(".")[-1]

    def from_change(names: Iterable[str]) -> dict:
        return {name: F.col(f"{view}.{name}") for name in names}

    on = " AND ".join(f"{target}.{key} = {view}.{key}" for key in KEYS)
    operation = F.col(f"{view}.operation_type")
    merge = (
        changes.alias(view)
        .mergeInto(table, F.expr(on))
        .whenMatched(operation == UPDATE)
        .update(from_change(UPDATED_BY_UPDATE))
        .whenMatched(operation == DELETE)
        .update(from_change(UPDATED_BY_DELETE))
    )
    if revive:
        gone = F.col(f"{target}.operation_type") == DELETE
        merge = merge.whenMatched((operation == INSERT) & gone).update(
            from_change(CHANGES.fieldNames())
        )
    merge.whenNotMatched().insert(from_change(CHANGES.fieldNames())).merge()


def _merge(
    changes: DataFrame, table: str, partition_by: Sequence[str], date_col: str, revive: bool
) -> bool:
    stored = changes.sparkSession.table(table)
    if partition_by:
        months, deletes = touched_months(changes)
        merged = merge_changes(in_months(stored, months), changes, revive=revive)
        merged = with_month(merged, date_col)
    else:
        # An unpartitioned table is replaced as a whole, so it must be read first.
        deletes = has_deletes(changes)
        merged = staged(merge_changes(stored, changes, revive=revive), "merged")
    _replace_partitions(merged, table, partition_by)
    return deletes


def _replace_partitions(df: DataFrame, table: str, partition_by: Sequence[str]) -> None:
    """Replace the partitions that ``df`` has rows of, and no others.

    ``df`` may read the same table: nothing of it is overwritten.
    """
    if tuple(partition_by) == PARTITIONS:
        replace_months(df, table)
        return
    # insertInto takes the overwrite mode from the session alone, not from an option.
    setting = "spark.sql.sources.partitionOverwriteMode"
    conf = df.sparkSession.conf
    before = conf.get(setting)
    conf.set(setting, "dynamic")
    try:
        _in_table_order(_spread(df, partition_by), table).write.insertInto(table, overwrite=True)
    finally:
        conf.set(setting, before)


def replace_months(df: DataFrame, table: str, months: Iterable[Month] = ()) -> list[Month]:
    """Make ``df`` the content of the months it has rows of; those of ``months`` that it
    has no rows of are dropped. Returns the months written.

    The rows are written first, to a folder of their own. Only then is one partition after
    the other pointed at its new files; the months to drop go last.
    """
    spark = df.sparkSession
    rows = _in_table_order(df, table)
    path = f"{table_location(spark, table)}/{_VERSIONS}/{uuid.uuid4().hex}"
    writer = _spread(rows, PARTITIONS).write.options(**_written())
    writer.partitionBy(*PARTITIONS).parquet(path)
    written = _written_months(spark, path, rows)
    stored = stored_months(spark, table)
    for month in written:
        _point_at(spark, table, month, f"{path}/{_folder(month)}", month in stored)
    drop_months(spark, table, set(months) - set(written))
    spark.catalog.refreshTable(table)
    return [month for month in written if None not in month]


def _written() -> dict[str, str]:
    return {"parquet.page.row.count.limit": _PAGE_ROWS}


def _written_months(spark: SparkSession, path: str, rows: DataFrame) -> list[Month]:
    """The months in a folder, the one of rows without a date included."""
    found = spark.read.schema(rows.schema).parquet(path).select(*PARTITIONS).distinct().collect()
    return sorted(((r.year, r.month) for r in found), key=lambda m: (m[0] is not None, m))


def _point_at(spark: SparkSession, table: str, month: Month, path: str, stored: bool) -> None:
    spec, place = _spec(month), _text(path)
    if not stored:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION {place}")
    else:
        spark.sql(f"ALTER TABLE {table} PARTITION ({spec}) SET LOCATION {place}")


def _spec(month: Month) -> str:
    return ", ".join(
        f"{name} = {'null' if value is None else int(value)}"
        for name, value in zip(PARTITIONS, month)
    )


def _folder(month: Month) -> str:
    """The folder that a partitioned write gives a month."""
    return "/".join(
        f"{name}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
        for name, value in zip(PARTITIONS, month)
    )


def _text(value: str) -> str:
    """A string as SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table_location(spark: SparkSession, table: str) -> str:
    """The folder of a table."""
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'")
    return found.first().data_type.rstrip("/")


def stored_months(spark: SparkSession, table: str) -> set[Month]:
    """The months that the catalog has partitions of; no file is read."""
    found = set()
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect():
        values = [part.split("=", 1)[1] for part in row.partition.split("/")]
        found.add(tuple(int(v) if v.lstrip("-").isdigit() else None for v in values))
    return found


def sweep_versions(spark: SparkSession, table: str, hours: float = 24.0) -> list[str]:
    """Remove versions of months that no partition points at, if they are older than
    ``hours``; returns their folders. A reader that began before that may fail.

    A version that a write under way has not pointed at yet is younger than any job runs;
    choose ``hours`` above that. The driver lists the table's files, not their rows.
    """
    mark = f"/{_VERSIONS}/"
    files = [path for path in spark.table(table).inputFiles() if mark in path]
    used = {path.split(mark)[1].split("/")[0] for path in files}
    root = f"{table_location(spark, table)}/{_VERSIONS}"
    gone = [
        path for path in folders_older_than(spark, root, hours) if path.rsplit("/", 1)[1] not in used
    ]
    for path in gone:
        remove_folder(spark, path)
    return gone


def _in_table_order(df: DataFrame, table: str) -> DataFrame:
    """Columns by name in the order of the table; insertInto goes by position."""
    columns = df.sparkSession.table(table).columns
    unknown = set(df.columns) - set(columns)
    if unknown:
        raise ValueError(f"{table} has no column {', '.join(sorted(unknown))}")
    return df.select(*columns)


def _spread(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a partition together, without one task per partition.

    With the rebalance hint Spark sizes the write tasks from the shuffled bytes: it
    splits a large month over several tasks and packs small months into one. Within a
    file, rows are in the order of the pairs, so that a scan for few pairs skips the rest.
    """
    if not partition_by:
        return df
    order = [name for name in (*partition_by, *PAIR, "date") if name in df.columns]
    return df.hint("rebalance", *partition_by).sortWithinPartitions(*order)

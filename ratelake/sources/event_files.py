"""JSON event files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_events(
    events: DataFrame, path: str, files: int | None = None, batch: str | None = None
) -> None:
    """Write events as JSON lines, one file per task; ``files`` asks for fewer.

    ``batch`` names what the events belong to: they are the whole content of its folder
    (``batch=<name>``, a column when all are read), so writing them again, after a failure
    that came between the write and its note, leaves each event there once. Without it they
    are appended. No change rows write no event. Null fields are left out of the JSON.
    """
    if files is not None:
        events = events.coalesce(files)
    if batch is None:
        events.write.mode("append").json(path)
    else:
        events.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch}")

"""Change rows as business events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.functions.columns import iso_millis

# The business fields of an event.
PAYLOAD = ("date", "base", "target", "base_amount", "rate", "row_hash")


def to_events(changes: DataFrame) -> DataFrame:
    """One event per change row: type, UTC time, entity and a nested payload."""
    return changes.select(
        F.col("operation_type").alias("event_type"),
        iso_millis(F.col("ingestion_timestamp")).alias("event_timestamp"),
        F.concat_ws("-", "base", "target", "date").alias("entity_id"),
        F.struct(*PAYLOAD).alias("payload"),
    )

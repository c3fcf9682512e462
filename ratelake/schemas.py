"""Column names, operation labels and relation schemas shared by all operators."""

from pyspark.sql import types as T

# The business key: one observation per day and currency pair.
KEYS = ("date", "base", "target")
PAIR = ("base", "target")

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"

RATES = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("base_amount", T.DoubleType()),
        T.StructField("base", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("rate", T.DoubleType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)

# A change row and a row of the stored base table have the same columns.
CHANGES = T.StructType(
    RATES.fields
    + [
        T.StructField("row_hash", T.StringType()),
        T.StructField("operation_type", T.StringType()),
        T.StructField("ingestion_timestamp", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("target_currency", T.StringType()),
        T.StructField("local_amount", T.DoubleType()),
    ]
)

CUSTOMERS = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("segment", T.StringType()),
    ]
)

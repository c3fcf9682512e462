"""Star schema: dimensions, facts and the converted transaction report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators.merge import live_rows
from ratelake.schemas import TRANSACTIONS

# The currencies of the literal dimension.
CURRENCIES = (
    ("USD", "United States Dollar"),
    ("EUR", "Euro"),
    ("BRL", "Brazilian Real"),
    ("MXN", "Mexican Peso"),
)

# The report's columns under their Spanish names.
SPANISH_REPORT_NAMES = {
    "customer_name": "cliente",
    "segment": "nivel",
    "source_currency": "moneda_origen",
    "local_amount": "monto_local",
    "daily_rate": "tipo_cambio_del_dia",
    "amount_in_usd": "total_en_usd",
}

# The columns of the converted report, in order.
REPORT = (
    "transaction_id",
    "date",
    "customer_name",
    "segment",
    "source_currency",
    "local_amount",
    "daily_rate",
    "amount_in_usd",
)


def currency_dimension(spark: SparkSession) -> DataFrame:
    """The literal currency dimension: code and name."""
    return spark.createDataFrame(CURRENCIES, "currency_code string, currency_name string")


def dimension(source: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """A dimension from a source table: {dimension column: source column}.

    The first column is the key. The source holds one row per key.
    """
    return source.select(*[F.col(old).alias(new) for new, old in columns.items()])


def fact_rates(changes: DataFrame) -> DataFrame:
    """Live rates: date, base, target, rate and when they came in."""
    if "ingestion_timestamp" not in changes.columns and "ingested_at" in changes.columns:
        changes = changes.withColumnRenamed("ingested_at", "ingestion_timestamp")
    return live_rows(changes).select("date", "base", "target", "rate", "ingestion_timestamp")


def fact_transactions(source: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Transaction facts from a source table: {fact column: source column}.

    The facts have the columns and types of the transaction schema, the date as the ISO
    text of its day. A value that does not fit its type raises an error.
    """
    missing = set(TRANSACTIONS.fieldNames()) - set(columns)
    if missing:
        raise ValueError(f"no source column for {', '.join(sorted(missing))}")
    kinds = {field.name: field.dataType for field in TRANSACTIONS.fields}
    values = {name: F.col(columns[name]) for name in kinds}
    values["date"] = values["date"].cast("date")
    return source.select(*[values[name].cast(kind).alias(name) for name, kind in kinds.items()])


def convert_transactions(
    transactions: DataFrame,
    customers: DataFrame,
    rates: DataFrame,
    names: Mapping[str, str] | None = None,
    base: str = "USD",
) -> DataFrame:
    """Each transaction with its customer and its amount in ``base`` at the rate of its day.

    Only the rates of ``base`` take part, so a transaction never meets the rates of two
    bases. Without a customer, or a rate on that day, there is no row.

    No broadcast hint: every input can grow. Spark broadcasts a side by its measured
    size, and past that size splits a hot customer or a hot day and currency on the
    transaction side (AQE skew join, possible since both joins are inner).
    """
    shown = {name: (names or {}).get(name, name) for name in REPORT}
    daily = rates.where(F.col("base") == base).select(
        "date",
        F.col("target").alias("source_currency"),
        F.col("rate").alias("daily_rate"),
    )
    owners = customers.select("customer_id", "customer_name", "segment")
    amounts = transactions.select(
        "transaction_id",
        "date",
        "customer_id",
        "local_amount",
        F.col("target_currency").alias("source_currency"),
    )
    priced = amounts.join(daily, ["date", "source_currency"]).join(owners, "customer_id")
    in_base = F.round(F.try_divide("local_amount", "daily_rate"), 2)
    report = priced.withColumn("amount_in_usd", in_base)
    return report.select(*[F.col(name).alias(label) for name, label in shown.items()])

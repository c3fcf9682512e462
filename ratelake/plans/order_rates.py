"""Rates, snapshots and transactions derived from the order tables.

Every order is one observation: its day, the customer's nation as the currency and
the square root of its price as the rate. The order's priority decides what happens
to it between two snapshots, and its status decides which stored rows are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.operators import clean_rates
from ratelake.schemas import DELETE, INSERT

FIRST_RUN = "2026-05-06 01:02:03.456"
SECOND_RUN = "2026-05-07 04:05:06.789"
THIRD_RUN = "2026-05-08 07:08:09.012"

# What the priority of an order stands for.
ONLY_NEW, ONLY_OLD, REVALUED = "1-URGENT", "2-HIGH", "3-MEDIUM"
# Rates of this priority are written as whole numbers where a document holds many.
WHOLE = "5-LOW"
# The status of orders whose stored row is a tombstone, where a query has some.
TOMBSTONE_STATUS = "P"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_text(stamp: Column) -> Column:
    """ISO text of the day of a zone-less timestamp."""
    return stamp.cast("date").cast("string")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; several orders may share a day and a currency."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            day_text(F.col("o_orderdate")).alias("date"),
            F.lit(1.0).alias("base_amount"),
            F.lit("USD").alias("base"),
            F.col("n_name").alias("target"),
            F.sqrt("o_totalprice").alias("rate"),
            F.lit(FIRST_RUN).cast("timestamp").alias("ingested_at"),
            F.col("o_orderkey").alias("src_id"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
        )
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks after cleaning: the lowest order key of a day and currency survives."""
    return clean_rates(ticks(spark, sf_dir), tie_break=["src_id"])


def dirty_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks in which orders of one status carry faults, one kind per priority."""
    faulty = F.col("status") == TOMBSTONE_STATUS
    priority = F.col("priority")
    return ticks(spark, sf_dir).withColumns(
        {
            "rate": F.when(faulty & (priority == "1-URGENT"), F.lit(None).cast("double"))
            .when(faulty & (priority == "2-HIGH"), 0.0)
            .when(faulty & (priority == "3-MEDIUM"), 500001.0)
            .when(faulty & (priority == "4-NOT SPECIFIED") & (F.col("rate") < 400), 0.00001)
            .when(faulty & (priority == "4-NOT SPECIFIED"), 500000.0)
            .otherwise(F.col("rate")),
            "target": F.when(faulty & (priority == "5-LOW"), F.lit(None).cast("string")).otherwise(
                F.col("target")
            ),
        }
    )


def old_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(spark, sf_dir).filter(F.col("priority") != ONLY_NEW)


def new_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    revalued = F.when(F.col("priority") == REVALUED, F.col("rate") * 1.01)
    return (
        rates(spark, sf_dir)
        .filter(F.col("priority") != ONLY_OLD)
        .withColumn("rate", revalued.otherwise(F.col("rate")))
        .withColumn("ingested_at", F.lit(SECOND_RUN).cast("timestamp"))
    )


def stored_rows(snapshot: DataFrame, with_tombstones: bool = False) -> DataFrame:
    """A snapshot as rows of the base table, all from the first run."""
    operation = F.lit(INSERT)
    if with_tombstones:
        operation = F.when(F.col("status") == TOMBSTONE_STATUS, DELETE).otherwise(INSERT)
    stamp = F.lit(FIRST_RUN).cast("timestamp")
    return snapshot.select(
        "date",
        "base_amount",
        "base",
        "target",
        "rate",
        "ingested_at",
        F.sha2(decimal_text(F.col("rate")), 256).alias("row_hash"),
        operation.alias("operation_type"),
        stamp.alias("ingestion_timestamp"),
        stamp.alias("updated_at"),
    )


def decimal_text(value: Column) -> Column:
    """Fixed-point text, the same in any SQL engine."""
    return value.cast("decimal(18,6)").cast("string")


def documents(observations: DataFrame) -> DataFrame:
    """Each observation as one JSON document, in a column named value."""
    by_day = F.create_map("date", F.create_map("target", "rate"))
    return observations.select(
        F.to_json(F.struct("base", by_day.alias("rates"))).alias("value")
    )


def wide_documents(observations: DataFrame) -> DataFrame:
    """One JSON document for each calendar month: its days, and on each all currencies.

    Documents of odd months name no base, the others EUR; rates of one priority are
    written as whole numbers. Observations are unique by day and currency.
    """
    number = F.when(F.col("priority") == WHOLE, F.floor("rate").cast("long").cast("string"))
    entry = F.concat(F.lit('"'), "target", F.lit('":'), number.otherwise(F.col("rate").cast("string")))
    days = observations.groupBy("date").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    day = F.concat(F.lit('"'), "date", F.lit('":{'), F.array_join("entries", ","), F.lit("}"))
    months = days.groupBy(F.substring("date", 1, 7).alias("month")).agg(
        F.sort_array(F.collect_list(day)).alias("days")
    )
    odd = F.substring("month", 6, 2).cast("int") % 2 == 1
    base = F.when(odd, F.lit("")).otherwise(F.lit('"base":"EUR",'))
    return months.select(
        F.concat(F.lit("{"), base, F.lit('"rates":{'), F.array_join("days", ","), F.lit("}}")).alias("value")
    )


def damaged_documents(observations: DataFrame) -> DataFrame:
    """The same documents, those of one order status with a fault for each priority."""
    faulty, priority = F.col("status") == TOMBSTONE_STATUS, F.col("priority")
    day = F.to_json(F.struct("date"))
    # The day's text as JSON, quotes included, to build documents by hand.
    date = F.regexp_extract(day, r":(.*)}$", 1)
    target = F.regexp_extract(F.to_json(F.struct("target")), r":(.*)}$", 1)

    def one(values: Column) -> Column:
        return F.concat(F.lit('{"base":"USD","rates":{'), date, F.lit(":"), values)

    def value(text: str) -> Column:
        return F.concat(F.lit("{"), target, F.lit(f":{text}}}"))

    return observations.select(
        F.when(faulty & (priority == "1-URGENT"), F.concat(one(value('"n/a"')), F.lit("}}")))
        .when(faulty & (priority == "2-HIGH"), F.concat(one(value("null")), F.lit("}}")))
        .when(faulty & (priority == "3-MEDIUM"), one(value("17.")))
        .when(faulty & (priority == "4-NOT SPECIFIED"), one(F.lit("null}}")))
        .otherwise(F.concat(one(value("17.25")), F.lit("}}")))
        .alias("value")
    )


def paid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as payments to the supplier's country on the shipping day."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
            "l_shipdate",
            "o_custkey",
            "n_name",
            "l_extendedprice",
        )
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paid lines as facts."""
    return paid_lines(spark, sf_dir).select(
        "transaction_id",
        day_text(F.col("l_shipdate")).alias("date"),
        F.col("o_custkey").alias("customer_id"),
        F.col("n_name").alias("target_currency"),
        F.col("l_extendedprice").alias("local_amount"),
    )

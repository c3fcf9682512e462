"""Nested rate documents: landed JSON in, one row per day and currency out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.functions.columns import run_stamp
from ratelake.schemas import RATES

# {"base": "USD", "rates": {"2026-05-06": {"MXN": 17.25, "EUR": 0.88}}}
# The innermost value is read as text, so that one bad number can be told from none.
DOCUMENT = "base string, rates map<string, map<string, string>>, unreadable string"

# The base of a document that names none, and the amount it prices.
DEFAULT_BASE = "USD"
BASE_AMOUNT = 1.0

# What is wrong with a document, a day of it, or a value.
UNREADABLE = "unreadable document"
EMPTY_DAY = "day without rates"
NO_VALUE = "no value"
NO_NUMBER = "not a number"

# Where a document comes from, if it was read from a file.
ORIGIN = ("received_at", "source_path")


def read_documents(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Documents from JSON files: one per line (such files split), or one per file.

    ``received_at`` and ``source_path`` are the file's time of change and name.
    """
    texts = spark.read.text(path, wholetext=one_per_file).select(
        "value",
        F.col("_metadata.file_modification_time").alias(ORIGIN[0]),
        F.col("_metadata.file_path").alias(ORIGIN[1]),
    )
    return parse_documents(texts.filter(F.trim("value") != ""))


def parse_documents(texts: DataFrame, column: str = "value") -> DataFrame:
    """Documents from a text column, with the origin columns if there are any.

    A text that is no such document is kept whole in ``unreadable``.
    """
    options = {"columnNameOfCorruptRecord": "unreadable"}
    origin = [name for name in ORIGIN if name in texts.columns]
    parsed = texts.select(
        F.from_json(F.col(column), DOCUMENT, options).alias("d"), F.col(column).alias("_text"), *origin
    )
    broken = F.when(F.col("d").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.col("d.unreadable"))
    return parsed.select("d.base", "d.rates", broken.alias("unreadable"), *origin)


def flatten_documents(documents: DataFrame, run_ts: datetime | str | None = None) -> DataFrame:
    """One row per date and currency of every document, good or bad.

    The rates schema, then ``problem`` (null for a good value), ``value_text`` (the text
    of the value, or of an unreadable document) and the origin columns. A problem with a
    whole document has no date, one with a whole day no target. A document without rates
    gives no row. Both explodes are narrow: rows stay in the task that read the document.
    """
    if "unreadable" not in documents.columns:
        documents = documents.withColumn("unreadable", F.lit(None).cast("string"))
    origin = [name for name in ORIGIN if name in documents.columns]
    readable = F.when(F.col("unreadable").isNull(), F.col("rates"))
    by_day = documents.select(
        "base", "unreadable", F.explode_outer(readable).alias("date", "_currencies"), *origin
    )
    each = by_day.select(
        "date",
        "base",
        "unreadable",
        F.col("_currencies").isNull().alias("_empty"),
        F.explode_outer("_currencies").alias("target", "_text"),
        *origin,
    )
    rate = F.col("_text").try_cast("double")
    problem = (
        F.when(F.col("unreadable").isNotNull(), UNREADABLE)
        .when(F.col("_empty"), EMPTY_DAY)
        .when(F.col("_text").isNull(), NO_VALUE)
        .when(rate.isNull(), NO_NUMBER)
    )
    has_row = F.col("target").isNotNull() | (F.col("date").isNotNull() & F.col("_empty"))
    return each.filter(F.col("unreadable").isNotNull() | has_row).select(
        "date",
        F.lit(BASE_AMOUNT).alias("base_amount"),
        F.coalesce("base", F.lit(DEFAULT_BASE)).alias("base"),
        "target",
        rate.alias("rate"),
        run_stamp(run_ts).alias("ingested_at"),
        problem.alias("problem"),
        F.coalesce("unreadable", "_text").alias("value_text"),
        *origin,
    )


def flatten_rates(documents: DataFrame, run_ts: datetime | str | None = None) -> DataFrame:
    """The values of all readable documents, in the rates schema; bad ones have no rate."""
    flat = flatten_documents(documents, run_ts).filter(F.col("target").isNotNull())
    return flat.select(*RATES.fieldNames())


def rejected(flat: DataFrame) -> DataFrame:
    """What cannot be used of flattened documents: the reason, the place and the text."""
    origin = [name for name in ORIGIN if name in flat.columns]
    bad = flat.filter(F.col("problem").isNotNull())
    return bad.select("problem", "date", "base", "target", "value_text", *origin)


def empty_rates(spark: SparkSession) -> DataFrame:
    """The typed empty relation of a batch without rates."""
    return spark.createDataFrame([], RATES)

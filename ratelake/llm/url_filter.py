"""Operator 5: URL lists as they stood when each page was fetched.

Dated entries (add or remove a key, from an instant on) become validity intervals: each
entry holds until the next one of its key. A capture is looked up under its host, the
domains above it and its whole address. Intervals are cut by month, so that the join is on
key and month with few intervals each; its large side, a hot host, Spark can split. The
most specific key with an entry in force decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port or a final dot; null if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def keys_of(url: Column) -> Column:
    """The keys of an address, the most specific first: itself, its host, the domains above.

    An address is stripped of its scheme and fragment. A domain has two labels or more.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    ups = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    address = F.regexp_replace(F.regexp_replace(url, r"^[^:/?#]+://", ""), r"#.*$", "")
    return F.when(host.isNotNull(), F.array_distinct(F.concat(F.array(address), ups)))


def validity(entries: DataFrame) -> DataFrame:
    """key, listed (boolean), since and until (null: still in force) of each interval.

    entries has key, listed and since. Of entries of a key at one instant, a listing one
    counts. Entries without a key or an instant are void; a null listed counts as false.
    """
    clean = entries.where("key is not null and since is not null")
    clean = clean.groupBy("key", "since").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    following = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    return clean.withColumn("until", following)


def _month(at: str) -> Column:
    return (F.year(at) * 12 + F.month(at)).alias("month")


def filter_captures(
    captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url",
    fetched: str = "fetched_at",
) -> DataFrame:
    """Key, url, fetched, blocked, entry (the key that decided) and since, of each capture.

    Without an entry in force, and for a null or malformed address or a null instant,
    blocked is false and entry null. An instant equal to an entry's belongs to it. Repeated
    captures get a row each and are looked up once; empty tables are fine; other columns
    of either table are not read.
    """
    rows = captures.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").alias("at")
    )
    asked = rows.select("url", "at").where("url is not null and at is not null").distinct()
    ranked = asked.select("url", "at", _month("at"), F.posexplode(keys_of(F.col("url"))).alias("rank", "entry"))
    last = rows.agg(F.max("at")).first()[0]
    listed = validity(entries.select("key", "listed", "since"))
    end = F.least(F.coalesce("until", F.lit(last)), F.lit(last))
    months = F.sequence(F.year("since") * 12 + F.month("since"), F.year(end) * 12 + F.month(end))
    if last is None:
        listed = listed.limit(0)
        months = F.array(F.lit(0))
    # Entries that start after the last capture are of no use to any.
    listed = listed.where(F.col("since") <= F.lit(last)) if last is not None else listed
    cut = listed.select(
        F.col("key").alias("entry"), "listed", "since", "until", F.explode(months).alias("month")
    )
    holds = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    found = ranked.join(cut, ["entry", "month"]).where(holds)
    first = F.min(F.struct("rank", "entry", "listed", "since")).alias("first")
    decided = found.groupBy("url", "at").agg(first)
    return rows.join(decided, ["url", "at"], "left").select(
        F.col("key").alias(key),
        F.col("url").alias(url),
        F.col("at").alias(fetched),
        F.coalesce(F.col("first.listed"), F.lit(False)).alias("blocked"),
        F.col("first.entry").alias("entry"),
        F.col("first.since").alias("since"),
    )

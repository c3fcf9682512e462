"""Operator 4: documents as raw ids in shards, with keyed access by a minimal perfect hash.

The store is a folder with two Parquet tables as containers, so that Spark's committer
guards it against lost tasks:

- ids: one row for each segment of a shard, with the ids of whole documents one after the
  other as raw little-endian integers (16 bits if the vocabulary allows, else 32), the
  number of ids and of documents of the shard before it, and its documents' keys and
  lengths. Shards follow each other in ascending key order, nulls first.
- index: one row for each part of the stored rows, by a hash of the key and of the row's
  number among those of its key, with the part's minimal perfect hash and, by slot, a
  32-bit fingerprint, the shard and segment, the place in the segment, the number of ids
  and the number of rows of the key.

A lookup hashes a key and a number, reads one index row, takes the slot, compares the
fingerprint and has the place of the payload: which segment, and where in it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratelake.llm.key_index import build, slots_of
from ratelake.llm.rows import arrow_schema, keyed_text, slices
from ratelake.llm.word_ids import word_encoder

#: Ids of a segment; one longer document is a segment of its own.
SEGMENT_IDS = 1 << 20
#: Keys of an index part, on average. A part is built in one task.
PART_KEYS = 1 << 15

_ENTRY = np.dtype(
    [("print", "<u4"), ("shard", "<i4"), ("segment", "<i4"), ("place", "<i8")]
    + [("n_tokens", "<i8"), ("rows", "<i8")]
)
#: What the index tells of a stored row.
PLACE = ("shard", "segment", "place", "n_tokens", "rows")


def write_store(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Encodes whole texts, appends end_id to each and writes a new store at path.

    A null or empty text is the end id alone; a null key is a key; rows that share a key
    follow each other (in order of a hash of their texts) and the index gives the first
    and their number. An empty table gives a store without rows. Other columns are not
    read. Equal keys are spread over tasks by that hash too, so none gathers in one task.
    """
    rows = keyed_text(docs, key, text).withColumn("tie", F.xxhash64("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"shard int, segment int, before long, docs_before long, keys array<{kind}>,"
        " lengths array<long>, width int, ids binary"
    )

    out = arrow_schema(schema)

    def task(batches):
        encode = word_encoder(vocabulary)
        shard = TaskContext.get().partitionId()
        last = np.array([end_id], encode.kind).tobytes()
        width = encode.kind.itemsize
        keys, lengths, parts = [], [], []
        segment, before, docs_before, held = 0, 0, 0, 0

        def row():
            values = (shard, segment, before, docs_before, keys, lengths, width, b"".join(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=f.type) for v, f in zip(values, out, strict=True)], schema=out
            )

        for part in slices(batches):
            for k, t in zip(part["key"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids = encode.encode(t) + last
                n = len(ids) // width
                if keys and held + n > SEGMENT_IDS:
                    yield row()
                    before, docs_before = before + held, docs_before + len(keys)
                    segment, held = segment + 1, 0
                    keys, lengths, parts = [], [], []
                keys.append(k)
                lengths.append(n)
                parts.append(ids)
                held += n
        if keys:
            yield row()

    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    ordered.mapInArrow(task, schema).write.parquet(f"{path}/ids")
    spark = docs.sparkSession
    _index(spark, path).write.parquet(f"{path}/index")


def _hashes(key: str, nth: str) -> list:
    """Two 64-bit hashes and a fingerprint of any atomic key, null included, and a number."""
    return [
        F.xxhash64(key, nth).alias("a"),
        F.xxhash64(key, nth, F.lit(1)).alias("b"),
        F.hash(key, nth, F.lit(2)).alias("print"),
    ]


def _part(key: str, nth: str, parts: int):
    return F.pmod(F.xxhash64(key, nth, F.lit(3)), F.lit(parts)).alias("part")


def _total(lengths: str):
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda x, y: x + y)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Each stored row with its key's number of rows and its own number among them.

    Rows of a key follow each other, so the number is that of rows since the key's first
    one. Only a key's first place and its count are gathered, summed up before the shuffle;
    the other rows of a key, however many, meet them by a join that can be split.
    """
    ids = spark.read.parquet(f"{path}/ids")
    docs = ids.groupBy("shard").agg(F.sum(F.size("keys")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("docs"))
    places = _places_of(ids).join(docs, "shard")
    places = places.select("key", (F.col("docs") + F.col("at")).alias("at"), *PLACE[:4])
    first = F.min(F.struct("at", *PLACE[:4])).alias("first")
    firsts = places.groupBy("key").agg(first, F.count("*").alias("rows"))
    several = firsts.where("rows > 1").select(
        F.col("key").alias("same"), F.col("first.at").alias("from"), "rows"
    )
    others = places.join(several, F.col("key").eqNullSafe(F.col("same")))
    others = others.withColumn("nth", F.col("at") - F.col("from")).where("nth > 0")
    return firsts.select("key", F.lit(0).cast("long").alias("nth"), "first.*", "rows").drop("at").unionByName(
        others.select("key", "nth", *PLACE)
    )


def _index(spark: SparkSession, path: str) -> DataFrame:
    parts = _parts(spark.read.parquet(f"{path}/ids"))
    keyed = _numbered(spark, path).select(_part("key", "nth", parts), *_hashes("key", "nth"), *PLACE)

    def one(part: pa.Table) -> pa.Table:
        column = {n: part[n].to_numpy() for n in part.column_names}
        a, b = (column[n].astype(np.int64).view(np.uint64) for n in "ab")
        index, slots = build(a, b)
        entries = np.zeros(len(a), _ENTRY)
        entries["print"][slots] = column["print"].astype(np.int32).view(np.uint32)
        for name in PLACE:
            entries[name][slots] = column[name]
        return pa.table(
            {
                "part": pa.array([column["part"][0]], pa.int64()),
                "parts": pa.array([parts], pa.int64()),
                "mph": pa.array([index], pa.binary()),
                "entries": pa.array([entries.tobytes()], pa.binary()),
            }
        )

    return keyed.groupBy("part").applyInArrow(
        one, "part long, parts long, mph binary, entries binary"
    )


def _places_of(ids: DataFrame) -> DataFrame:
    kind = ids.schema["keys"].dataType.elementType.simpleString()
    schema = f"key {kind}, shard int, at long, segment int, place long, n_tokens long"

    out = arrow_schema(schema)

    def task(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = batch["lengths"][row].values.to_numpy()
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["keys"][row].values,
                        pa.array(np.full(n, batch["shard"][row].as_py(), np.int32)),
                        pa.array(batch["docs_before"][row].as_py() + np.arange(n)),
                        pa.array(np.full(n, batch["segment"][row].as_py(), np.int32)),
                        pa.array(np.cumsum(lengths) - lengths),
                        pa.array(lengths),
                    ],
                    schema=out,
                )

    return ids.select("shard", "segment", "docs_before", "keys", "lengths").mapInArrow(task, schema)


def _parts(ids: DataFrame) -> int:
    n = ids.select(F.sum(F.size("keys"))).first()[0] or 0
    return max(1, -(-n // PART_KEYS))


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, shard, segment, place in it, n_tokens and rows of each different key of a table.

    The place is that of the key's first row; rows tells how many it has. Keys that the
    store does not hold are missing from the result (but for one in four billion by its
    fingerprint). Equal keys are looked up once.
    """
    asked = keys.select(F.col(f"`{key}`").alias("key")).distinct()
    found = _looked_up(spark, path, asked.withColumn("nth", F.lit(0).cast("long")))
    return found.drop("nth").withColumnRenamed("key", key)


def lookup_rows(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same for every row of each key, numbered by nth from 0."""
    asked = keys.select(F.col(f"`{key}`").alias("key")).distinct()
    first = _looked_up(spark, path, asked.withColumn("nth", F.lit(0).cast("long")))
    more = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows") - 1)).alias("nth")
    others = _looked_up(spark, path, first.where("rows > 1").select("key", more))
    return first.unionByName(others).withColumnRenamed("key", key)


def _looked_up(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The index entries of different pairs of a key and a number."""
    index = spark.read.parquet(f"{path}/index")
    kind = asked.schema["key"].dataType.simpleString()
    head = index.select("parts").first()
    parts = head[0] if head else 1
    asked = asked.select(_part("key", "nth", parts), "key", "nth", *_hashes("key", "nth"))
    schema = f"key {kind}, nth long, shard int, segment int, place long, n_tokens long, rows long"
    out = arrow_schema(schema)

    def one(want: pa.Table, have: pa.Table) -> pa.Table:
        if not want.num_rows or not have.num_rows:
            return out.empty_table()
        a, b = (want[n].to_numpy().astype(np.int64).view(np.uint64) for n in "ab")
        slots = slots_of(have["mph"][0].as_py(), a, b)
        entries = np.frombuffer(have["entries"][0].as_py(), _ENTRY)
        prints = want["print"].to_numpy().astype(np.int32).view(np.uint32)
        found = (slots >= 0) & (entries["print"][slots] == prints)
        at = entries[slots[found]]
        mask = pa.array(found)
        return pa.table(
            [want["key"].filter(mask), want["nth"].filter(mask)] + [pa.array(at[n]) for n in PLACE],
            schema=out,
        )

    return asked.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(one, schema)


def stored_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Key, shard, segment, place in it, offset in the shard, n_tokens and ids_crc32 of each
    document, from the payload.

    The checksum is of the ids as 32-bit little-endian integers, whatever their width.
    """
    ids = spark.read.parquet(f"{path}/ids")
    kind = ids.schema["keys"].dataType.elementType.simpleString()
    schema = (
        f"key {kind}, shard int, segment int, place long, offset long, n_tokens long, ids_crc32 long"
    )

    out = arrow_schema(schema)

    def task(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                width = batch["width"][row].as_py()
                payload = np.frombuffer(batch["ids"][row].as_buffer(), f"<u{width}")
                lengths = batch["lengths"][row].values.to_numpy()
                ends = np.cumsum(lengths)
                sums = [
                    zlib.crc32(payload[end - n : end].astype("<u4"))
                    for n, end in zip(lengths, ends, strict=True)
                ]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["keys"][row].values,
                        pa.array(np.full(n, batch["shard"][row].as_py(), np.int32)),
                        pa.array(np.full(n, batch["segment"][row].as_py(), np.int32)),
                        pa.array(ends - lengths),
                        pa.array(batch["before"][row].as_py() + ends - lengths),
                        pa.array(lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    schema=out,
                )

    columns = ids.select("shard", "segment", "before", "keys", "lengths", "width", "ids")
    rows = columns.mapInArrow(task, schema)
    return rows.select(F.col("key").alias(key), *rows.columns[1:])


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Shard and the number of ids in all shards before it; one row for each write task."""
    ids = spark.read.parquet(f"{path}/ids")
    sums = ids.groupBy("shard").agg(F.sum(_total("lengths")).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_ids(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key and ids (array) of the first stored row of each asked key, through the index.

    The index names the segment, so each place meets one row of the payload.
    """
    ids = spark.read.parquet(f"{path}/ids").select("shard", "segment", "width", "ids")
    found = lookup(spark, path, keys, key).withColumnRenamed(key, "key")
    kind = found.schema["key"].dataType.simpleString()
    cut = found.join(ids, ["shard", "segment"]).select(
        "key",
        "width",
        F.substring(
            "ids",
            (F.col("place") * F.col("width") + 1).cast("int"),
            (F.col("n_tokens") * F.col("width")).cast("int"),
        ).alias("ids"),
    )
    schema = f"key {kind}, ids array<long>"

    out = arrow_schema(schema)

    def task(batches):
        for batch in batches:
            values = [
                np.frombuffer(b, f"<u{w}").astype(np.int64)
                for b, w in zip(batch["ids"].to_pylist(), batch["width"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(values, out.field("ids").type)], schema=out
            )

    rows = cut.mapInArrow(task, schema)
    return rows.select(F.col("key").alias(key), "ids")

"""What the operators share: the input table, shared folders and batch plumbing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ratelake.sources.shared import shared_folder

#: Input rows that one slice of a batch holds as Python objects at a time.
SLICE_ROWS = 512
SLICE_BYTES = 8 << 20
#: Longer strings are not remembered, so that memories stay bounded in bytes too.
CACHED_LENGTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text only, under names of our own; other columns cannot clash."""
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))


def staged_rows(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_schema(docs: DataFrame, key: str, rest: str) -> StructType:
    """A key of the same type as in docs, a struct of other columns included, then rest."""
    first = StructField("key", docs.schema[key].dataType)
    return StructType([first, *_parse_datatype_string(rest).fields])


def arrow_schema(schema: str | StructType) -> pa.Schema:
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return to_arrow_schema(kind)


def slices(
    batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS
) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that few texts are Python objects at the same time."""
    for batch in batches:
        at, size = 0, max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, SLICE_BYTES // size))
        while at < batch.num_rows:
            yield batch.slice(at, step)
            at += step


class Remembered(dict):
    """A bounded memory of a function of strings; it starts anew when it is full."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, word: str):
        value = self.function(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


class Recent(Remembered):
    """The same in two halves: a full one takes the place of the other, which goes with all
    that was not asked for again, so what is frequent stays."""

    def __init__(self, function, most: int):
        super().__init__(function, most)
        self.before: dict = {}

    def __missing__(self, word: str):
        value = self.before.get(word)
        if value is None:
            value = self.function(word)
        if len(word) <= CACHED_LENGTH:
            if 2 * len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[word] = value
        return value


#: What a Python worker keeps between tasks, each with the module that it serves.
_KEPT: list[tuple[str, Callable]] = []


def kept_by(module: str) -> Callable:
    """Marks a cached function: tasks of other modules drop what it keeps."""

    def mark(cached):
        _KEPT.append((module, cached))
        return cached

    return mark


def drop_others(module: str) -> None:
    """Drops what other modules' tasks left in this worker: one operator's memories at a
    time, however many operators a session runs."""
    held = [c for m, c in _KEPT if m != module and c.cache_info().currsize]
    for cached in held:
        cached.cache_clear()
    if held:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: a Python worker lives on,
    and the next operator's task in it has memories of its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_rows(
    df: DataFrame,
    schema: str | StructType,
    start: Callable[[], Callable[[pa.RecordBatch], dict | None]],
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """mapInArrow over slices: start() runs once a task, its result once a slice.

    The slice function returns a list for each column of the schema.
    """

    kind = arrow_schema(schema)

    def task(batches):
        yield from coded(start(), batches)

    def coded(one, batches):
        for part in slices(batches, rows):
            columns = one(part)
            if columns is not None and len(next(iter(columns.values()))):
                yield pa.RecordBatch.from_arrays(
                    [
                        x if isinstance(x, pa.Array) else pa.array(x, type=field.type)
                        for field in kind
                        for x in [columns[field.name]]
                    ],
                    schema=kind,
                )

    return map_batches(df, task, schema, start.__module__)


def map_batches(
    df: DataFrame,
    task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
    module: str | None = None,
) -> DataFrame:
    """mapInArrow; memory that a task has freed goes back to the system when it ends."""
    module = module or task.__module__

    def whole(batches):
        drop_others(module)
        yield from task(batches)
        give_back()

    return df.mapInArrow(whole, schema)

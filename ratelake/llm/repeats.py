"""Operator 7: long byte strings that occur twice, by suffix arrays over shards.

Two equal strings of the given length have the same least hash of 32 bytes in them. The
starts of a text that share their least hash form a run, and that hash deals the runs:

1. The hashes of all runs are counted. Only those that occur twice can hold a repeat.
2. Runs with such a hash are cut from their texts (with the rest of their last string)
   where they lie, by a bit array of those hashes, and dealt out by the hash. A task sends
   texts that are equal as a whole once.
3. A task joins the runs of a few hashes to a shard, sorts its suffixes by induction and
   takes the permuted common prefixes: a string repeats if its suffix shares its whole
   length with the one before or after it. Equal runs enter the shard once.
4. What repeats is cut from each text in one pass; texts without repeats are not moved.

A hash with so many runs that a shard would outgrow a task (a passage in a large part of
all texts) is dealt out further, by the whole string that starts at each of its places:
strings that hash alike are counted, partly before the shuffle. No run is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.llm.hash_filter import HashFilter
from ratelake.llm.rows import (
    arrow_schema, keyed_schema, keyed_text, map_batches, map_rows, slices, staged_rows,
)
from ratelake.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 200
#: Bytes of a hashed piece (a power of two), and of a text that are hashed at a time.
PIECE = 32
BLOCK = 1 << 18
#: Bytes of a shard, after which a new one starts; runs of a hash that one shard can take.
SHARD_BYTES = 1 << 19
SHARD_RUNS = 5000
#: Regions that are equal to others and to nothing else, held until their spans are sent.
WHOLE_REGIONS = 2000
#: Different texts that a task remembers to have sent.
SENT_TEXTS = 100_000

_STEPS = tuple(
    np.uint64(x)
    for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
              0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)
)
#: Stands between the runs of a shard; no UTF-8 text has this byte.
_BETWEEN = b"\xff"


def _piece_hashes(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of the size bytes from each place on."""
    x = (data.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    parts, width = {1: x}, 1
    while width * 2 <= size:
        x = parts[width]
        y = x[:-width] * _STEPS[width.bit_length() % len(_STEPS)] + x[width:]
        parts[width * 2] = y ^ (y >> np.uint64(31))
        width *= 2
    whole, done = parts[width], width
    while done < size:
        width = 1 << ((size - done).bit_length() - 1)
        n = len(data) - done - width + 1
        whole = whole[:n] * _STEPS[0] + parts[width][done : done + n]
        whole ^= whole >> np.uint64(30)
        done += width
    return whole


def _pieces_of(data: bytes) -> np.ndarray:
    return _piece_hashes(np.frombuffer(data, np.uint8), PIECE).view(np.int64)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of the size values from each place on."""
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs(texts: list[bytes], length: int = LENGTH, count_places: bool = True):
    """Yields arrays (text, hash, first start, starts, places of the hash) of runs.

    Short texts are hashed side by side, long ones block by block; a run never crosses
    two texts.
    """
    held: list[int] = []
    size = 0
    for i, data in enumerate(texts):
        if len(data) < length:
            continue
        held.append(i)
        size += len(data)
        if size >= BLOCK:
            yield from _runs_of(held, texts, length, count_places)
            held, size = [], 0
    if held:
        yield from _runs_of(held, texts, length, count_places)


def _runs_of(held: list[int], texts: list[bytes], length: int, count_places: bool):
    if len(texts[held[0]]) <= 2 * BLOCK or len(held) > 1:
        pieces = [(i, 0, texts[i]) for i in held]
        yield _runs_in(pieces, length, count_places)
        return
    (i,) = held
    for low in range(0, len(texts[i]) - length + 1, BLOCK):
        piece = texts[i][low : low + BLOCK + length - 1]
        yield _runs_in([(i, low, piece)], length, count_places)


def _runs_in(pieces: list[tuple[int, int, bytes]], length: int, count_places: bool):
    """Runs of pieces (text, first byte, bytes), hashed as one array."""
    sizes = np.array([len(data) for _, _, data in pieces])
    begin = np.cumsum(sizes) - sizes
    hashes = _piece_hashes(np.frombuffer(b"".join(p[2] for p in pieces), np.uint8), PIECE)
    least = _least(hashes, length - PIECE + 1)
    change = np.ones(len(least), bool)
    change[1:] = least[1:] != least[:-1]
    change[begin] = True
    # Starts whose string would leave its piece belong to no run.
    ends = begin + sizes - length + 1
    change[ends[ends < len(least)]] = True
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, len(least)))
    piece = np.searchsorted(begin, start, side="right") - 1
    inside = start < ends[piece]
    start, count, piece = start[inside], count[inside], piece[inside]
    key = least[start]
    places = np.ones(len(start), np.int64)
    if count_places:
        # A hash at two places of a run lets two of its strings be equal.
        reach = length - PIECE
        for r, (s, n, k) in enumerate(
            zip(start.tolist(), count.tolist(), key.tolist(), strict=True)
        ):
            places[r] = np.count_nonzero(hashes[s : s + n + reach] == k)
    text = np.array([i for i, _, _ in pieces])[piece]
    first = start - begin[piece] + np.array([low for _, low, _ in pieces])[piece]
    return text, key.view(np.int64), first, count, places


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, and a 128-bit hash (a, b) of the text."""
    return keyed_text(docs, key, text).withColumns(
        {"a": F.xxhash64("text"), "b": F.xxhash64("text", F.lit(1))}
    )


def _all_runs(rows: DataFrame, length: int) -> DataFrame:
    """The hash of each run, and at how many places of it the hash occurs."""
    schema = "hash long, places long"
    out = arrow_schema(schema)

    def task(batches):
        for part in slices(batches):
            texts = [(t or "").encode() for t in part["text"].to_pylist()]
            for _, key, _, _, places in runs(texts, length):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(places)], schema=out)

    return map_batches(rows.select("text"), task, schema)


def _shards(regions: DataFrame, length: int) -> DataFrame:
    """a, b, first and last byte of the repeated parts of regions, dealt by their hash."""
    schema = "a long, b long, first long, last long"
    out = arrow_schema(schema)

    def spans(held: dict[bytes, list[tuple[int, int, int]]]):
        """held: for each different region of a shard its places (a, b, first)."""
        texts = list(held)
        whole = np.frombuffer(_BETWEEN.join(texts) + _BETWEEN, np.uint8)
        order = suffix_array(whole)
        shared = common_prefixes(whole, order)
        after = np.zeros(len(whole), np.int64)
        after[order[:-1]] = shared[order[1:]]
        longest = np.maximum(shared, after)
        found: list[tuple[int, int, int, int]] = []
        at = 0
        for t in texts:
            starts = len(t) - length + 1
            again = longest[at : at + starts] >= length
            if len(held[t]) > 1:
                again[:] = True
            at += len(t) + 1
            if again.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], again, [0]])))
                for a, b, first in held[t]:
                    for low, high in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        found.append((a, b, first + low, first + high - 1 + length))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], pa.int64()) for i in range(4)], schema=out
        )

    def whole(held: dict[bytes, list[tuple[int, int, int]]]):
        """Regions that repeat as a whole, with no other region that shares their hash."""
        found = [(a, b, x, x + len(t)) for t, places in held.items() for a, b, x in places]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], pa.int64()) for i in range(4)], schema=out
        )

    def task(batches):
        shard: dict[bytes, list[tuple[int, int, int]]] = {}
        own: dict[bytes, list[tuple[int, int, int]]] = {}
        alone: dict[bytes, list[tuple[int, int, int]]] = {}
        size, last = 0, None

        def close():
            """The regions of one hash are complete: equal ones alone need no sorting, and
            a single one none if its hash occurs once in it."""
            nonlocal size
            if len(own) == 1:
                ((data, places),) = own.items()
                if len(places) > 1:
                    alone.update(own)
                elif np.count_nonzero(_pieces_of(data) == last) > 1:
                    shard.update(own)
                    size += len(data)
            else:
                shard.update(own)
                size += sum(map(len, own))
            own.clear()

        for part in slices(batches):
            columns = [part[n].to_pylist() for n in ("hash", "a", "b", "first", "bytes")]
            for mark, a, b, first, data in zip(*columns, strict=True):
                if mark != last:
                    close()
                    if size > SHARD_BYTES:
                        yield spans(shard)
                        shard.clear()
                        size = 0
                    if len(alone) > WHOLE_REGIONS:
                        yield whole(alone)
                        alone.clear()
                last = mark
                own.setdefault(data, []).append((a, b, first))
        close()
        if shard:
            yield spans(shard)
        if alone:
            yield whole(alone)

    dealt = regions.repartition("hash").sortWithinPartitions("hash")
    return map_batches(dealt, task, schema)


def _strings(regions: DataFrame, length: int) -> DataFrame:
    """For each start of the regions a 128-bit hash (x, y) of its string."""
    schema = "x long, y long, a long, b long, first long"
    out = arrow_schema(schema)

    def task(batches):
        for part in slices(batches):
            for data, a, b, first in zip(
                *(part[n].to_pylist() for n in ("bytes", "a", "b", "first")), strict=True
            ):
                whole = np.frombuffer(data, np.uint8)
                n = len(whole) - length + 1
                columns = [_piece_hashes(whole, length, seed).view(np.int64) for seed in (7, 77)]
                columns += [np.full(n, a), np.full(n, b), first + np.arange(n)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=out)

    return map_batches(regions, task, schema)


def _packed(rows: DataFrame, some: HashFilter) -> DataFrame:
    """key, a, b and the compressed text of rows that may have something to remove."""
    schema = keyed_schema(rows, "key", "a long, b long, packed binary")
    out = arrow_schema(schema)

    def task(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            part = part.filter(pa.array(some.may_hold(part["a"].to_numpy())))
            texts = [pack.compress((t or "").encode()) for t in part["text"].to_pylist()]
            columns = [part["key"], part["a"], part["b"], pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_batches(rows.select("key", "a", "b", "text"), task, schema)


def _unpacked(packed: list[bytes]) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(data) for data in packed]


def _regions(
    rows: DataFrame, again: HashFilter, length: int, hot: HashFilter | None, want_hot: bool
) -> DataFrame:
    """hash, a, b, first and bytes of the runs of each text whose hash may occur twice, and
    which is in ``hot`` or not.

    A task sends equal texts once. Texts that tasks send again only add places to regions
    that repeat anyway.
    """
    schema = "hash long, a long, b long, first long, bytes binary"
    out = arrow_schema(schema)

    def task(batches):
        sent: set[tuple[int, int]] = set()
        for part in slices(batches):
            marks = list(zip(part["a"].to_pylist(), part["b"].to_pylist(), strict=True))
            texts = [
                b"" if mark in sent or sent.add(mark) else (t or "").encode()
                for mark, t in zip(marks, part["text"].to_pylist(), strict=True)
            ]
            if len(sent) > SENT_TEXTS:
                sent.clear()
            for text, key, first, starts, _ in runs(texts, length, False):
                chosen = again.may_hold(key)
                if hot is not None:
                    chosen &= hot.may_hold(key) == want_hot
                some = np.flatnonzero(chosen)
                lows, highs = first[some].tolist(), (first + starts + length - 1)[some].tolist()
                of = text[some].tolist()
                columns = [
                    key[some],
                    [marks[i][0] for i in of],
                    [marks[i][1] for i in of],
                    lows,
                    [texts[i][low:high] for i, low, high in zip(of, lows, highs, strict=True)],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out
                )

    return map_batches(rows.select("a", "b", "text"), task, schema)


def repeated_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    shard_runs: int = SHARD_RUNS,
) -> DataFrame:
    """a, b (hash of a text), copies and spans (first, last byte) of each text with a repeat."""
    rows = _identified(docs, key, text)
    counted = _all_runs(rows, length)
    counted = counted.groupBy("hash").agg(F.sum("places").alias("places"), F.count("*").alias("n"))
    again = staged_rows(counted.where("places > 1").select("hash", "n"), "hashes")
    copies = staged_rows(rows.groupBy("a", "b").agg(F.count("*").alias("copies")), "copies")
    wanted = HashFilter(again, "hash")
    frequent = again.where(F.col("n") > shard_runs).select("hash")
    # Each hash goes one way, by its bit alone; both ways are exact for any hash.
    hot = None if frequent.isEmpty() else HashFilter(frequent, "hash")
    spans = _shards(_regions(rows, wanted, length, hot, False), length)
    if hot is not None:
        # Of a text that several tasks send, which has copies, every string does occur twice.
        regions = _regions(rows, wanted, length, hot, True)
        strings = staged_rows(_strings(regions, length), "strings")
        twice = strings.groupBy("x", "y").count().where("count > 1").select("x", "y")
        ends = (F.col("first") + length).alias("last")
        spans = spans.unionByName(strings.join(twice, ["x", "y"]).select("a", "b", "first", ends))
    # Written, so that the shuffled texts and runs can go before texts are read again.
    spans = staged_rows(spans, "spans")
    lists = spans.groupBy("a", "b").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return copies.where("copies > 1").select("a", "b", "copies").join(lists, ["a", "b"], "full")


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    shard_runs: int = SHARD_RUNS, whole_characters: bool = False,
) -> DataFrame:
    """Key, kept (the bytes left), n_bytes, n_removed and removed (spans) of each row.

    A byte goes if a string of the given length that covers it starts anywhere else in
    the table, in the same text too; strings are judged on the input and do not cross
    texts. A null text is empty and keeps a null-free empty value; a row with a repeated
    key is a text of its own; equal texts of at least that length lose all their bytes;
    an empty table gives no rows; other columns are not read. Texts of any length are
    taken whole, hashed in blocks. whole_characters widens each cut to the characters that
    it would split, so that what is left is text.
    """
    rows = _identified(docs, key, text)
    found = staged_rows(repeated_spans(docs, key, text, length, shard_runs), "repeats")
    some = HashFilter(found.select("a"), "a")
    rest = "kept binary, n_bytes long, n_removed long, removed array<struct<first:long,last:long>>"
    schema = keyed_schema(docs, key, rest)

    def start():
        def one(part):
            kept, sizes, gone, spans = [], [], [], []
            texts = _unpacked(part["packed"].to_pylist())
            for data, copies, found in zip(
                texts, part["copies"].to_pylist(), part["spans"].to_pylist(), strict=True
            ):
                if (copies or 0) > 1 and len(data) >= length:
                    cuts = [(0, len(data))]
                else:
                    cuts = _joined([(x["first"], x["last"]) for x in found or ()])
                if whole_characters:
                    cuts = _joined([_widened(data, low, high) for low, high in cuts])
                sizes.append(len(data))
                gone.append(sum(high - low for low, high in cuts))
                spans.append([{"first": low, "last": high} for low, high in cuts])
                edges = [0, *(x for span in cuts for x in span), len(data)]
                kept.append(
                    b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                )
            return {
                "key": part["key"],
                "kept": kept,
                "n_bytes": sizes,
                "n_removed": gone,
                "removed": spans,
            }

        return one

    def start_whole():
        def one(part):
            part = part.filter(pa.array(~some.may_hold(part["a"].to_numpy())))
            kept = [(t or "").encode() for t in part["text"].to_pylist()]
            return {
                "key": part["key"],
                "kept": kept,
                "n_bytes": [len(x) for x in kept],
                "n_removed": [0] * len(kept),
                "removed": [[] for _ in kept],
            }

        return one

    # Texts that surely lose nothing stay where they are; the others meet their spans.
    whole = map_rows(rows.select("key", "a", "text"), schema, start_whole)
    joined = _packed(rows, some).join(found, ["a", "b"], "left")
    cut = map_rows(joined.select("key", "packed", "copies", "spans"), schema, start)
    out = whole.unionByName(cut)
    return out.select(F.col("key").alias(key), *out.columns[1:])


def _widened(data: bytes, low: int, high: int) -> tuple[int, int]:
    """A span of UTF-8 bytes that begins and ends between characters."""
    while low > 0 and data[low] & 0xC0 == 0x80:
        low -= 1
    while high < len(data) and data[high] & 0xC0 == 0x80:
        high += 1
    return low, high


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what the spans cover; touching ones are one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out

"""Operator 6: near duplicates by SimHash and a hierarchical index in Gray order.

1. A fingerprint for each text, in the task that reads it.
2. Equal fingerprints become one node, before any search.
3. Nodes are dealt out so that every two within the allowed distance meet: the bits that
   a group has not fixed are cut into distance + 1 parts, of which such a pair shares one.
   Groups that are still large are cut again by their other bits, as often as needed, so
   no group gathers more than a bounded number of nodes and no pair is lost.
4. A task sorts its groups by Gray rank, which puts similar fingerprints side by side,
   and builds a tree over them: a node keeps the bits that all below it share and its
   parent does not fix. A search adds up differences on the way down and drops a whole
   subtree once they pass the allowed distance, or once it is all in one component.
5. A task sends the links of a spanning forest, never all pairs; links of all tasks are
   joined to components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.llm.components import components
from ratelake.llm.rows import arrow_schema, keyed_schema, keyed_text, map_batches, map_rows, staged_rows

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Nodes of a group beyond which it is cut again; nodes that a task indexes at a time.
GROUP_NODES = 20_000
INDEX_NODES = 400_000
#: Children of a tree node, and searches that go down the tree together.
FANOUT = 8
SEARCHES = 4096
#: Shingles hashed at a time, which bounds the memory for a very long text.
HASHES = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased words' shingles; 0 for a text without words or null."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    count = max(1, len(words) - shingle + 1)
    ends = (starts + sizes)[min(shingle, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for low in range(0, count, HASHES):
        part = slice(low, low + HASHES)
        hashes = np.array(
            [
                xxhash.xxh64_intdigest(joined[a:b], SEED)
                for a, b in zip(starts[:count][part].tolist(), ends[part].tolist(), strict=True)
            ],
            "<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """key, tie (a hash of the text) and fp (the fingerprint as a signed long)."""

    def start():
        return lambda part: {
            "key": part["key"],
            "tie": part["tie"],
            "fp": np.array(
                [fingerprint(t, shingle) for t in part["text"].to_pylist()], np.uint64
            ).view(np.int64),
        }

    rows = keyed_text(docs, key, text).withColumn("tie", F.xxhash64("text"))
    return map_rows(rows, keyed_schema(docs, key, "tie long, fp long"), start)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over codes sorted by group and Gray rank."""

    def __init__(self, group: np.ndarray, code: np.ndarray, distance: int):
        order = np.lexsort((gray_rank(code), group))
        self.group, self.code, self.distance = group[order], code[order], distance
        self.root = np.arange(len(code))
        ands, ors = [self.code], [self.code]
        self.bounds = [np.arange(len(code) + 1)]
        while len(ands[-1]) > FANOUT:
            cut = np.arange(0, len(ands[-1]), FANOUT)
            ands.append(np.bitwise_and.reduceat(ands[-1], cut))
            ors.append(np.bitwise_or.reduceat(ors[-1], cut))
            self.bounds.append(np.append(self.bounds[-1][cut], len(code)))
        # shared: bits on which all codes below agree; own: those the parent does not fix.
        shared = [~(a ^ o) for a, o in zip(ands, ors, strict=True)]
        self.pattern = ands
        self.own = [
            s & ~np.repeat(up, FANOUT)[: len(s)]
            for s, up in zip(shared, [*shared[1:], np.zeros(1, np.uint64)], strict=False)
        ]
        self.own[-1] = shared[-1]

    def _spread(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each tree node the least and greatest component below it."""
        low = high = self.root
        out = [(low, high)]
        while len(low) > FANOUT:
            cut = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            out.append((low, high))
        return out

    def _search(self, query: np.ndarray, spread) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later place) within the distance that do not yet share a component."""
        top = len(self.own) - 1
        who = np.repeat(query, len(self.own[top]))
        node = np.tile(np.arange(len(self.own[top])), len(query))
        paid = np.zeros(len(who), np.int64)
        for level in range(top, -1, -1):
            bounds, (low, high) = self.bounds[level], spread[level]
            first, last = bounds[node], bounds[node + 1] - 1
            group = self.group[who]
            alive = (
                (last > who)
                & (self.group[first] <= group)
                & (self.group[last] >= group)
                & ~((low[node] == high[node]) & (low[node] == self.root[who]))
            )
            who, node, paid = who[alive], node[alive], paid[alive]
            differs = (self.code[who] ^ self.pattern[level][node]) & self.own[level][node]
            paid = paid + np.bitwise_count(differs)
            alive = paid <= self.distance
            who, node, paid = who[alive], node[alive], paid[alive]
            if level:
                below = len(self.own[level - 1])
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                who, paid = np.repeat(who, FANOUT), np.repeat(paid, FANOUT)
                inside = node < below
                who, node, paid = who[inside], node[inside], paid[inside]
        same = self.group[who] == self.group[node]
        return who[same], node[same]

    def forest(self) -> np.ndarray:
        """For each place the least place of its component."""
        n, step = len(self.code), 64
        at = 0
        while at < n:
            # The first searches join dense groups, so that later ones can skip them.
            query = np.arange(at, min(n, at + step))
            a, b = self._search(query, self._spread())
            if len(a):
                self._join(a, b)
            at, step = at + step, min(SEARCHES, step * 2)
        return self.root

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins components by pointing roots at smaller ones until nothing changes."""
        root = self.root
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                break
            x, y = x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def links(nodes: DataFrame, distance: int = DISTANCE, group_nodes: int = GROUP_NODES) -> DataFrame:
    """Links a, b between different codes of column fp that make the right components."""
    open_ = nodes.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"))
    ready = None
    while True:
        sizes = open_.groupBy("mask", "value").count()
        large = staged_rows(sizes.where(F.col("count") > group_nodes).select("mask", "value"), "large")
        masks = [row[0] for row in large.select("mask").distinct().collect()]
        # With fewer open bits than parts a group has a few nodes at most.
        masks = [m for m in masks if 64 - (m % (1 << 64)).bit_count() > distance]
        if not masks:
            ready = open_ if ready is None else ready.unionByName(open_)
            break
        # At most (distance + 1) ** rounds masks, not groups, are known to the driver.
        large = large.where(F.col("mask").isin(masks))
        rest = open_.join(large, ["mask", "value"], "left_anti")
        ready = rest if ready is None else ready.unionByName(rest)
        cut = F.create_map(
            *[x for m in masks for x in (F.lit(m), F.array(*map(F.lit, _cuts(m, distance + 1))))]
        )
        hot = open_.join(large, ["mask", "value"], "left_semi")
        cut_again = hot.select("fp", F.explode(cut[F.col("mask")]).alias("mask"))
        open_ = cut_again.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    schema = "a long, b long"
    out = arrow_schema(schema)

    def task(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush(rows: np.ndarray):
            change = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            group = np.concatenate([[0], np.cumsum(change)])
            index = GrayIndex(group, rows[:, 2].view(np.uint64), distance)
            root = index.forest()
            codes = index.code.view(np.int64)
            tied = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays(
                [pa.array(codes[tied]), pa.array(codes[root[tied]])], schema=out
            )

        for batch in batches:
            held.append(
                np.stack([batch[n].to_numpy() for n in ("mask", "value", "fp")], axis=1)
            )
            size += batch.num_rows
            if size >= INDEX_NODES:
                rows = np.concatenate(held)
                # The last group may go on in the next batch.
                change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
                if len(change):
                    yield flush(rows[: change[-1] + 1])
                    rows = rows[change[-1] + 1 :]
                held, size = [rows], len(rows)
        if size:
            yield flush(np.concatenate(held))

    dealt = ready.repartition("mask", "value").sortWithinPartitions("mask", "value")
    return map_batches(dealt.select("mask", "value", "fp"), task, schema)


def _cuts(mask: int, parts: int) -> list[int]:
    """The mask with each of so many parts of its other bits added, as signed longs."""
    free = [b for b in range(64) if not mask >> b & 1]
    added = [sum(1 << b for b in free[i * len(free) // parts : (i + 1) * len(free) // parts]) for i in range(parts)]
    whole = [(mask % (1 << 64)) | x for x in added]
    return [x - (1 << 64) if x >> 63 else x for x in whole]


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
    distance: int = DISTANCE, group_nodes: int = GROUP_NODES,
) -> DataFrame:
    """Key, tie, fingerprint (16 hex digits), component_id, linked and chosen of each row.

    component_id is the smallest key of the component (null keys come last), linked the
    number of its rows, tie a hash of the text; chosen marks the component's row with the
    smallest key, then tie, and the rows equal to it. A null text and one without words
    have fingerprint zero and are linked like any other; repeated rows are one node; an
    empty table gives no rows; other columns are not read.
    """
    rows = staged_rows(fingerprints(docs, key, text, shingle), "fingerprints")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "tie")).alias("first")
    nodes = staged_rows(rows.groupBy("fp").agg(first, F.count("*").alias("n")), "nodes")
    found = components(links(nodes.select("fp"), distance, group_nodes))
    placed = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    heads = placed.groupBy("component").agg(F.min("first").alias("head"), F.sum("n").alias("linked"))
    placed = placed.select("fp", "component").join(heads, "component").select("fp", "head", "linked")
    same = F.col("key").eqNullSafe(F.col("head.key")) & (F.col("tie") == F.col("head.tie"))
    return rows.join(placed, "fp").select(
        F.col("key").alias(key),
        "tie",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.key").alias("component_id"),
        "linked",
        same.alias("chosen"),
    )

"""Operator 3: training texts that hold copies of test items, edited ones included.

The test items are the query set. They are taken in blocks of a bounded number of words;
a block is broadcast and meets every text in the task that reads it, so no text is
shuffled. For each block:

1. The words and the pairs of neighbouring words that a text shares with each item are
   counted from posting lists. They bound the score of any alignment from above: between
   matches that are not neighbours on both sides lies a penalty at least, so m matches
   with b kept pairs score at most m + b + 1, and never more than 2 m.
2. Where the bound reaches the score asked for, in the text and then in a stretch as long
   as a copy can be, the stretch is aligned with the item (Smith-Waterman over words:
   match 2, mismatch and gap -1). The score is taken relative to that of an exact copy.

Nothing but the bound decides what is aligned, so no copy that reaches the score is
passed over, however its edits lie.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ratelake.llm.rows import arrow_schema, keyed_schema, keyed_text, map_batches, slices

#: Items of fewer words match nothing.
SHORTEST = 4
#: Words of a text that are looked at together, besides the length of the longest copy.
PIECE = 512
#: Words of a block of items; it bounds what is broadcast and what the driver holds.
BLOCK_WORDS = 400_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score relative to an exact copy, and, apart from it, least matches (or all words
#: of a shorter item).
LEAST_SCORE, LEAST_WORDS = 0.5, 8
#: Alignments that a task remembers, for texts that hold the same words.
REMEMBERED = 20_000

#: Scripts written without spaces (Thai, Lao, Myanmar, Khmer, Kana, Han): each letter is
#: a word of its own.
UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u19e0-\u19ff\u3005-\u3007\u3041-\u312f\u31a0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f"
    "\U0001b000-\U0001b16f\U00020000-\U0003ffff"
)
_SPACED_WORDS = re.compile(r"\w+").findall
_WORDS = re.compile(rf"[^\W{UNSPACED}]+|[^\W\d_]").findall


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return _SPACED_WORDS(text) if text.isascii() else _WORDS(text)


def _pairs(ids: np.ndarray) -> np.ndarray:
    """Each id and the next as one number; 0 where one of them is 0."""
    left, right = ids[:-1], ids[1:]
    return np.where((left > 0) & (right > 0), left << 32 | right, 0)


class _Postings:
    """The numbers of the items that hold each value, and how often they hold it."""

    def __init__(self, lists: list[np.ndarray]):
        none = np.zeros(0, np.int64)
        values = np.concatenate([none, *lists])
        number = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        pairs, self.times = np.unique(np.stack([values, number]), axis=1, return_counts=True)
        self.item = pairs[1].astype(np.int64)
        self.known, begin, self.size = np.unique(pairs[0], return_index=True, return_counts=True)
        self.begin = begin.astype(np.int64)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each item that holds a value: place of the value, place in the lists."""
        if not len(self.known) or not len(values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        (place,) = np.nonzero(self.known[at] == values)
        at = at[place]
        size = self.size[at]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(place, size), np.repeat(self.begin[at], size) + inner


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int, int]:
    """Best local score of the item in the words, the first and last word, the matches.

    Among alignments of the best score the one with most matches counts.
    """
    score, matches, last = _best(item, words)
    if score <= 0:
        return 0, 0, 0, 0
    # Backwards from the last word, the best alignment ends at the first.
    _, _, first = _best(item[::-1], words[: last + 1][::-1])
    return score, last - first, last, matches


def _best(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    n = len(words)
    # A score counts in units; below them its matches are counted.
    unit = len(item) + 1
    ramp = np.arange(n + 1) * (-GAP * unit)
    row = np.zeros(n + 1, np.int64)
    best = at = 0
    for word in item:
        step = np.zeros(n + 1, np.int64)
        step[1:] = row[:-1] + np.where(words == word, MATCH * unit + 1, MISMATCH * unit)
        step = np.maximum(step, row + GAP * unit)
        # Gaps within the row: the best of all places before, less their distance.
        row = np.maximum.accumulate(step + ramp) - ramp
        row[row < unit] = 0
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), top
    return best // unit, best % unit, at - 1


class _Block:
    """Items of a block with their vocabulary and posting lists."""

    def __init__(self, items: list[tuple], least_score: float):
        texts = [words_of(text) for _, text in items]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        kept = [i for i, t in enumerate(texts) if len(t) >= SHORTEST]
        self.keys = [items[i][0] for i in kept]
        self.items = [self.numbers(texts[i]) for i in kept]
        self.words = _Postings(self.items)
        self.pairs = _Postings([_pairs(x) for x in self.items])
        size = np.array([len(x) for x in self.items], np.int64)
        #: Least score of each item, and most words of a text that an alignment with it
        #: spans: each word beyond the item's own is a gap.
        self.least = MATCH * least_score * size
        self.matches = np.minimum(LEAST_WORDS, size)
        self.span = size + np.maximum(0, MATCH * size - self.least).astype(np.int64)
        self.most = int(self.span.max(initial=0))

    def numbers(self, words: list[str]) -> np.ndarray:
        get = self.ids.get
        return np.array([get(w, 0) for w in words], np.int64)

    def windows(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last) word ranges that may hold a copy, in pieces of the text."""
        step = max(PIECE, self.most)
        for low in range(0, max(1, len(ids) - self.most), step):
            for item, first, last in self._windows(ids[low : low + step + self.most]):
                yield item, low + first, low + last

    def _windows(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        n = len(self.items)
        known, times = np.unique(ids[ids > 0], return_counts=True)
        of, at = self.words.find(known)
        shared = np.minimum(times[of], self.words.times[at])
        words = np.bincount(self.words.item[at], weights=shared, minlength=n)
        may = (MATCH * words >= self.least) & (words >= self.matches)
        if not may.any():
            return
        place, at = self.pairs.find(_pairs(ids))
        held = self.pairs.item[at]
        bound = np.minimum(MATCH * words, words + np.bincount(held, minlength=n) + 1)
        for item in np.flatnonzero(may & (bound >= self.least)).tolist():
            mine = np.isin(ids, self.items[item])
            gain = mine.astype(np.int64)
            gain[place[held == item]] += 1
            total = np.concatenate([[0], np.cumsum(gain)])
            span, least = int(self.span[item]), self.least[item]
            ends = np.minimum(np.arange(len(ids)) + span, len(ids))
            # An alignment begins at a word of the item.
            (begins,) = np.nonzero(mine & (total[ends] - total[:-1] + 1 >= least))
            if not len(begins):
                continue
            cuts = np.flatnonzero(begins[1:] > begins[:-1] + span)
            firsts = begins[np.concatenate([[0], cuts + 1])]
            lasts = ends[begins[np.concatenate([cuts, [len(begins) - 1]])]]
            need = np.bincount(self.items[item])
            for first, last in zip(firsts.tolist(), lasts.tolist(), strict=True):
                part = np.bincount(ids[first:last], minlength=len(need))[: len(need)]
                m = np.minimum(part, need)[1:].sum()
                pairs = gain[first:last].sum() - mine[first:last].sum()
                if m >= self.matches[item] and min(MATCH * m, m + pairs + 1) >= least:
                    last = first + int(np.flatnonzero(mine[first:last])[-1]) + 1
                    yield item, first, last


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", least_score: float = LEAST_SCORE,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Key, item key, score (0 to 1), first and last word of each copy of an item in a text.

    One row for each text row and item whose best alignment scores at least least_score
    and matches LEAST_WORDS words, or the whole of a shorter item. Words are runs of
    letters, digits and underscores in lower case, and single letters of scripts without
    spaces. Items of fewer than SHORTEST words, null
    and empty texts match nothing; equal items and repeated rows give a row each; empty
    tables give no rows; null keys stay; other columns are not read. Whole texts are
    searched, for every item.
    """
    item = items.schema[item_key].dataType.simpleString()
    schema = keyed_schema(docs, key, f"item {item}, score double, first long, last long")
    rows, asked = keyed_text(docs, key, text), keyed_text(items, item_key, item_text)
    blocks = max(1, -(-_count_words(asked) // block_words))
    number = F.pmod(F.xxhash64("key", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        # A block has a bounded number of words; no other data reaches the driver.
        block = _Block([tuple(r) for r in asked.where(number == b).collect()], least_score)
        found = _search(rows, block, schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key), "score", "first", "last")


def _count_words(rows: DataFrame) -> int:
    """All words of the texts, as words_of cuts them in any script."""

    def task(batches):
        n = sum(len(words_of(t)) for part in slices(batches) for t in part["text"].to_pylist())
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return map_batches(rows.select("text"), task, "n long").agg(F.sum("n")).first()[0] or 0


def _search(rows: DataFrame, block: _Block, schema: StructType) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)
    out = arrow_schema(schema)

    def search(batches):
        held = shared.value
        memory: OrderedDict[tuple, tuple[int, int, int, int]] = OrderedDict()
        for part in slices(batches):
            found = []
            for k, t in zip(part["key"].to_pylist(), part["text"].to_pylist(), strict=True):
                ids = held.numbers(words_of(t))
                best: dict[int, tuple[float, int, int]] = {}
                for item, low, high in held.windows(ids):
                    words, window = held.items[item], ids[low:high]
                    known = (item, window.tobytes())
                    if known not in memory:
                        memory[known] = align(words, window)
                        if len(memory) > REMEMBERED:
                            memory.popitem(last=False)
                    score, first, last, matches = memory[known]
                    if score >= held.least[item] and matches >= held.matches[item]:
                        share = score / (MATCH * len(words))
                        if item not in best or share > best[item][0]:
                            best[item] = (share, low + first, low + last)
                found += [(k, held.keys[item], *value) for item, value in sorted(best.items())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], f.type) for i, f in enumerate(out)], schema=out
            )

    return map_batches(rows, search, schema)

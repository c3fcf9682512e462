"""Operator 1: token counts of a byte-level BPE vocabulary, without making identifiers.

A text is cut as the vocabulary's pre-tokenizer cuts it. The bytes of each piece form a
linked list; a heap holds the rank of each adjacent pair. The lowest rank is popped and
merged until no pair has one; the count of a piece is its bytes less its merges.

Pieces recur, so each Python worker keeps the counts of recent words, up to a fixed
number. One worker needs no other worker's rows: no shuffle, no broadcast.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.llm.rows import Remembered, keyed_schema, keyed_text, map_rows

#: The public pre-tokenizer pattern of byte-level BPE files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose counts a worker remembers; beyond it the memory starts anew.
CACHED_WORDS = 1_000_000
#: A blank inside or at the end of a run of white space: there, words depend on each other.
_TIED_BLANK = re.compile(r"\s \s|\s $")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class PairMerger:
    """Counts tokens with the merge ranks of a vocabulary file."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in merges]
        self.first = [vocab[c] for c in byte_characters()]
        self.rank = {(vocab[a] << 20) | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len)
        self.special = re.compile("|".join(map(re.escape, reversed(special)))) if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.piece = Remembered(lambda p: self.merged(p.encode()), cached)
        self.word = Remembered(lambda w: self._pieces_of(" " + w), cached)

    def merged(self, piece: bytes) -> int:
        """Bytes less merges: always the lowest rank first, the leftmost among equals."""
        n, rank = len(piece), self.rank.get
        symbol = [self.first[b] for b in piece]
        heap = [
            (r << 32) | i
            for i in range(n - 1)
            if (r := rank((symbol[i] << 20) | symbol[i + 1])) is not None
        ]
        heapify(heap)
        after, before, left = [*range(1, n + 1)], [*range(-1, n - 1)], n
        while heap:
            entry = heappop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            # An entry is stale once either symbol of its pair has changed.
            if symbol[i] < 0 or j >= n or rank((symbol[i] << 20) | symbol[j]) != r:
                continue
            symbol[i], symbol[j] = self.made[r], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (x := rank((symbol[i] << 20) | symbol[k])) is not None:
                    heappush(heap, (x << 32) | i)
            if (h := before[i]) >= 0 and (x := rank((symbol[h] << 20) | symbol[i])) is not None:
                heappush(heap, (x << 32) | h)
        return left

    def _pieces_of(self, text: str) -> int:
        return sum(map(self.piece.__getitem__, self.pieces(text)))

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings, word by word where that is the same.

        No piece holds a blank before its last white space but at its start, so a text
        may be cut before each blank that has no white space on either side or on one.
        """
        if _TIED_BLANK.search(text):
            return self._pieces_of(text)
        first, *rest = text.split(" ")
        return self._pieces_of(first) + sum(map(self.word.__getitem__, rest))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; a special string counts one; null counts as empty."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    """One for each Python worker, kept between its tasks."""
    return PairMerger(path)


def token_counts(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 1024
) -> DataFrame:
    """Key, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    vocabulary is the path of a byte-level BPE file on every machine. A null or empty
    text has 0 bytes and 0 tokens; a null key stays null; repeated rows are counted each;
    an empty table gives no rows; other columns are not read. A word of any length is
    merged in n log n steps.
    """

    def start():
        count = merger(vocabulary).count
        return lambda part: {
            "key": part.column("key"),
            "n_bytes": part.column("n_bytes"),
            "n_tokens": [count(t) for t in part.column("text").to_pylist()],
        }

    measured = keyed_text(docs, key, text).withColumn(
        "n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    )
    counted = map_rows(measured, keyed_schema(docs, key, "n_bytes long, n_tokens long"), start)
    return counted.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

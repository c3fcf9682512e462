"""Operator 12: alignment of two tokenizers, with corpus-wide counts of token pairs.

Both tokenizers cut the same bytes. Tokens that share bytes are linked; where both end at
the same byte a group ends. How often a pair of ids is linked in the whole corpus tells
how good a link is, so documents are read twice:

1. Each task aligns its documents and sums the links of each pair. The distinct pairs are
   dealt into a fixed number of buckets by the second id, and each bucket gets a minimal
   perfect hash. Its counts are then a dense vector in the order of the hash: partial
   vectors are summed in a tree, a few in a task. The pairs themselves are stored in that
   order, so that a pair looked up is verified.
2. Each task aligns its documents again and looks the counts up.

The index goes to the tasks as a whole if it is small (its size is checked); else each
task's pairs are dealt to the buckets, where they meet the index, and come back as sums.

Alignment is local: both tokenizers cut before a blank between two other signs (checked
for the vocabularies at hand), so a word is aligned once and remembered. Words that are
new are encoded and aligned together, as arrays.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from tokenizers import Tokenizer

from ratelake.llm.key_index import build, slots_of
from ratelake.llm.rows import arrow_schema, keyed_schema, keyed_text, slices, staged_rows

BLANK = "▁"
#: A blank between two signs that are neither white space nor the blank's own sign.
_CUT = re.compile(f"(?<=[^\\s{BLANK}]) (?=[^\\s{BLANK}])")
_CLEAN = re.compile(f"(?s)[^\\s{BLANK}](?:.*[^\\s{BLANK}])?\\Z")
#: White space that a text may hold beside blanks; that of ASCII first.
_ASCII_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_SPACES = [c for c in map(chr, range(0x80, 0x3001)) if c.isspace()] + [BLANK]

#: Words, and characters of them, that a task remembers before it starts anew.
WORDS = 700_000
LETTERS = 16 << 20
#: Parts of the table of pairs, by their second id.
BUCKETS = 128
#: Map tasks whose counts are summed first, and vectors summed at a time afterwards.
TASKS_OF_LEAF = 256
FAN = 8
#: Largest index that each task gets as a whole.
BROADCAST_BYTES = 64 << 20
#: Distinct pairs that a task holds before it passes their sums on.
PAIRS = 2_000_000


class Vocabularies:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        # Special strings in a text are ordinary text.
        self.a.encode_special_tokens = True
        self.b = lib = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs = _byte_signs()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(entries.values(), default=0) + 1)
        for entry, i in entries.items():
            self.bytes_a[i] = bytes(signs[c] for c in entry)
        self.bytes_b = [_piece_bytes(lib, i) for i in range(lib.get_piece_size())]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        small = max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16
        self.shift, self.kind = (16, np.dtype("<u4")) if small else (32, np.dtype("<u8"))
        self.mask = (1 << self.shift) - 1
        # A word's place in a text changes no token of it, or whole texts are encoded.
        kinds = (lib.is_control, lib.is_unknown, lib.is_byte, lib.is_unused)
        pieces = [
            lib.id_to_piece(i) for i in range(len(self.bytes_b)) if not any(k(i) for k in kinds)
        ]
        rules = json.loads(self.a.to_str())
        # With all bytes in the vocabulary and a text taken as it is, every byte comes back.
        self.lossless = rules["normalizer"] is None and len({x for x in self.bytes_a if len(x) == 1}) == 256
        self.words_apart = (
            not any(BLANK in piece.lstrip(BLANK) for piece in pieces)
            and lib.normalize("a  B ") == f"{BLANK}a{BLANK * 2}B{BLANK}"
            and rules["normalizer"] is None
            and rules["pre_tokenizer"]["type"] == "ByteLevel"
            and rules["pre_tokenizer"]["use_regex"]
            and not rules["pre_tokenizer"]["add_prefix_space"]
        )
        self.ends = [
            [f"{i}{sign}" for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
            for sign in ",|;"
        ]

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the blank before it."""
        if not self.words_apart:
            return [text]
        plain = "  " not in text and text[:1] != " " and text[-1:] != " "
        spaces = [_ASCII_SPACES] if text.isascii() else [_ASCII_SPACES, _SPACES]
        if plain and not any(c in text and (" " + c in text or c + " " in text) for s in spaces for c in s):
            return text.split(" ")
        return _CUT.split(text)


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """One for each Python worker, kept between its tasks."""
    return Vocabularies(path_a, path_b)


def _byte_signs() -> dict[str, int]:
    """The sign of each byte in byte-level vocabularies: printable ones are themselves,
    the others, in order, the signs from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _piece_bytes(lib: sentencepiece.SentencePieceProcessor, i: int) -> bytes:
    piece = lib.id_to_piece(i)
    if lib.is_byte(i):
        return bytes([int(piece[3:5], 16)])
    return b"" if lib.is_control(i) or lib.is_unknown(i) else piece.replace(BLANK, " ").encode()


@dataclass
class Aligned:
    """Words with their links: pairs, and for each word how many pairs, tokens and groups
    it has; ``good`` is False for a word whose tokens do not give its bytes back."""

    pairs: np.ndarray
    links: np.ndarray
    tokens_a: np.ndarray
    tokens_b: np.ndarray
    groups: np.ndarray
    good: np.ndarray
    texts: list[str]


def align(v: Vocabularies, words: Sequence[str], texts: bool = True) -> Aligned:
    """Aligns words; ``texts`` asks for the groups as text too."""
    data = [(" " + word).encode() for word in words]
    ids_b = v.b.encode(list(words), num_threads=1)
    of_b = np.array([len(x) for x in ids_b], np.int64)
    flat_b = np.fromiter((i for x in ids_b for i in x), np.int64, int(of_b.sum()))
    flat_a, of_a = _ids_a(v, words, data)
    good = _gives_bytes(flat_b, of_b, v.bytes_b, data)
    if not v.lossless:
        good &= _gives_bytes(flat_a, of_a, v.bytes_a, data)
    if not good.all():
        flat_a, flat_b = flat_a[np.repeat(good, of_a)], flat_b[np.repeat(good, of_b)]
        of_a, of_b = of_a * good, of_b * good
    # All words in one row: both sides end at each word's end.
    ends_a, ends_b = np.cumsum(v.sizes_a[flat_a]), np.cumsum(v.sizes_b[flat_b])
    at_a, at_b = np.zeros((2, int(ends_a[-1]) + 1 if len(ends_a) else 1), bool)
    at_a[ends_a] = at_b[ends_b] = True
    ends, both = np.flatnonzero(at_a | at_b), np.flatnonzero(at_a & at_b)
    pairs = (flat_a[np.searchsorted(ends_a, ends)] << v.shift) | flat_b[np.searchsorted(ends_b, ends)]
    word_ends = np.cumsum([len(x) if ok else 0 for x, ok in zip(data, good)])
    links = np.diff(np.searchsorted(ends, word_ends, "right"), prepend=0)
    groups = np.diff(np.searchsorted(both, word_ends, "right"), prepend=0)
    out = Aligned(pairs.astype(v.kind), links, of_a, of_b, groups, good, [])
    if texts:
        out.texts = _group_texts(v, flat_a, flat_b, ends_a, ends_b, both, np.cumsum(of_a + of_b))
    return out


def _ids_a(v: Vocabularies, words: Sequence[str], data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the first tokenizer for all words, and how many each has.

    Words that begin and end with a sign are encoded in one text, which is what encoding
    them in their texts is; the others each on their own.
    """
    clean = [_CLEAN.match(word) is not None and v.words_apart for word in words]
    whole = "".join(" " + word for word, ok in zip(words, clean) if ok)
    others = [" " + word for word, ok in zip(words, clean) if not ok]
    found = v.a.encode_batch_fast([whole, *others], add_special_tokens=False)
    ids = np.array(found[0].ids, np.int64)
    lengths = np.array([len(x) for x, ok in zip(data, clean) if ok], np.int64)
    ends = np.cumsum(v.sizes_a[ids])
    if len(lengths) and (not len(ends) or ends[-1] != lengths.sum()):
        raise AssertionError("a byte-level vocabulary gives every byte back")
    of_clean = np.diff(np.searchsorted(ends, np.cumsum(lengths), "right"), prepend=0)
    if not others:
        return ids, of_clean
    rest = [np.array(x.ids, np.int64) for x in found[1:]]
    parts, pieces = iter(np.split(ids, np.cumsum(of_clean)[:-1]) if len(lengths) else []), iter(rest)
    each = [next(parts) if ok else next(pieces) for ok in clean]
    return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def _gives_bytes(ids: np.ndarray, of: np.ndarray, table: list[bytes], data: list[bytes]) -> np.ndarray:
    """For each word, whether its tokens' bytes are the word's."""
    tokens = list(map(table.__getitem__, ids.tolist()))
    if b"".join(tokens) == b"".join(data):
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        at, word_ends = np.cumsum(of), np.cumsum([len(x) for x in data])
        if not (of == 0).any() and (ends[at - 1] == word_ends).all():
            return np.ones(len(data), bool)
    at = np.cumsum(of)
    return np.array(
        [b"".join(tokens[end - n : end]) == word for end, n, word in zip(at, of, data)], bool
    )


def _group_texts(v, flat_a, flat_b, ends_a, ends_b, both, word_ends) -> list[str]:
    """For each word its groups, as in ``a1,a2|b1;a3|b2,b3``."""
    group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
    # In a group the first side's tokens come first; the last of a side has its own sign.
    side = np.concatenate([group_a * 2, group_b * 2 + 1])
    order = np.argsort(side, kind="stable")
    ids, side = np.concatenate([flat_a, flat_b])[order], side[order]
    last = np.append(side[1:] != side[:-1], True) if len(side) else np.zeros(0, bool)
    sign = np.where(last, 1 + (side & 1), 0)
    comma, bar, semicolon = v.ends
    tables = (comma, bar, semicolon)
    texts = [tables[s][i] for s, i in zip(sign.tolist(), ids.tolist())]
    out, low = [], 0
    for high in word_ends.tolist():
        out.append("".join(texts[low:high])[:-1])
        low = high
    return out


class Memory:
    """Words that a task has aligned, each with a number and what ``made`` keeps of it."""

    def __init__(self, v: Vocabularies, made):
        self.v, self.made = v, made
        self.at: dict[str, int] = {}
        self.bad: set[int] = set()
        self.letters = 0

    def full(self) -> bool:
        return len(self.at) > WORDS or self.letters > LETTERS

    def clear(self) -> None:
        self.at.clear()
        self.bad.clear()
        self.letters = 0

    def learn(self, words: list[str]) -> None:
        if words:
            first = len(self.at)
            aligned = align(self.v, words, self.made.texts)
            self.at.update(zip(words, range(first, first + len(words))))
            self.bad.update((first + np.nonzero(~aligned.good)[0]).tolist())
            self.letters += sum(map(len, words))
            self.made.add(aligned)

    def documents(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's words; none if the text has no tokens."""
        parts = [self.v.words(t) if t else [] for t in texts]
        self.learn(list(set().union(*parts).difference(self.at)))
        out = [np.fromiter(map(self.at.__getitem__, words), np.int64, len(words)) for words in parts]
        if self.bad:
            # A text with such a word is judged as a whole.
            doubtful = [i for i, x in enumerate(out) if not self.bad.isdisjoint(x.tolist())]
            self.learn(list({texts[i] for i in doubtful if texts[i] not in self.at}))
            for i in doubtful:
                number = self.at[texts[i]]
                out[i] = np.array([] if number in self.bad else [number], np.int64)
        return out


# --- the first pass: counts of pairs


class _Counted:
    """The pairs of the words that are remembered, and how often each word came."""

    texts = False

    def __init__(self):
        self.clear()

    def clear(self):
        self.pairs, self.links = [], []
        self.seen = np.zeros(0, np.int64)

    def add(self, aligned: Aligned):
        self.pairs.append(aligned.pairs)
        self.links.append(aligned.links)

    def count(self, words: np.ndarray):
        seen = np.bincount(words, minlength=len(self.seen))
        seen[: len(self.seen)] += self.seen
        self.seen = seen

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        links = np.concatenate(self.links)
        seen = np.zeros(len(links), np.int64)
        seen[: len(self.seen)] = self.seen
        return summed(np.concatenate(self.pairs), np.repeat(seen, links))


def summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their counts above zero."""
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    first = np.nonzero(np.append(True, pairs[1:] != pairs[:-1]))[0] if len(pairs) else order
    sums = np.add.reduceat(counts, first) if len(pairs) else counts
    return pairs[first][sums > 0], sums[sums > 0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(pairs: np.ndarray, mask: int) -> np.ndarray:
    """A pair's bucket: all pairs of a second id share one."""
    seconds = pairs.astype(np.uint64) & np.uint64(mask)
    return (_mixed(seconds + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64)


def _by_bucket(pairs: np.ndarray, mask: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has pairs, with their places."""
    buckets = _bucket(pairs, mask)
    order = np.argsort(buckets, kind="stable")
    ends = np.searchsorted(buckets[order], np.arange(BUCKETS + 1))
    for b in range(BUCKETS):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


_COUNTS = "bucket int, leaf int, pairs binary, counts binary"


def _partial_counts(docs: DataFrame, paths: tuple[str, str], tasks_of_leaf: int) -> DataFrame:
    """Sums of each task: packed pairs and counts for each bucket."""
    kind = arrow_schema(_COUNTS)

    def task(batches):
        v = vocabularies(*paths)
        counted = _Counted()
        memory = Memory(v, counted)
        leaf = TaskContext.get().partitionId() // tasks_of_leaf
        pairs, counts = np.zeros(0, v.kind), np.zeros(0, np.int64)

        def settled():
            """The sums so far with those of the words that are remembered."""
            more, times = counted.sums() if counted.pairs else (pairs[:0], counts[:0])
            memory.clear()
            counted.clear()
            return summed(np.concatenate([pairs, more]), np.concatenate([counts, times]))

        def packed():
            found = list(_by_bucket(pairs, v.mask))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _ in found], pa.int32()),
                    pa.array([leaf] * len(found), pa.int32()),
                    pa.array([pairs[at].tobytes() for _, at in found], pa.binary()),
                    pa.array([counts[at].tobytes() for _, at in found], pa.binary()),
                ],
                schema=kind,
            )

        for part in slices(batches):
            words = memory.documents(part.column("text").to_pylist())
            if words:
                counted.count(np.concatenate(words))
            if memory.full():
                pairs, counts = settled()
                if len(pairs) > PAIRS:
                    yield packed()
                    pairs, counts = pairs[:0], counts[:0]
        pairs, counts = settled()
        if len(pairs):
            yield packed()

    return docs.mapInArrow(task, _COUNTS)


def _merged_counts(v_kind: str):
    """Sums the packed counts of a group: of one bucket and leaf."""
    kind = arrow_schema(_COUNTS)

    def merge(table: pa.Table) -> pa.Table:
        pairs = np.frombuffer(b"".join(table.column("pairs").to_pylist()), v_kind)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i8")
        pairs, counts = summed(pairs, counts)
        first = table.slice(0, 1)
        values = [
            first.column("bucket").to_pylist(),
            first.column("leaf").to_pylist(),
            [pairs.tobytes()],
            [counts.astype("<i8").tobytes()],
        ]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(values, kind)], schema=kind)

    return merge


def _tree(rows: DataFrame, schema: str, name: str, merge) -> DataFrame:
    """Merges the rows of a bucket, FAN leaves at a time, until each has one."""
    most = rows.agg(F.max("leaf")).first()[0] or 0
    while most > 0:
        leaf = F.floor(F.col("leaf") / FAN).cast("int").alias("leaf")
        above = rows.select("bucket", leaf, *[c for c in rows.columns if c not in ("bucket", "leaf")])
        rows = staged_rows(above.groupBy("bucket", "leaf").applyInArrow(merge, schema), name)
        most //= FAN
    return rows


_DISTINCT = "bucket int, leaf int, pairs binary"
_HASHED = "bucket int, index binary, pairs binary"
_VECTOR = "bucket int, leaf int, vector binary"
_TABLE = "bucket int, index binary, pairs binary, counts binary, best binary"


def pair_counts(
    docs: DataFrame, paths: tuple[str, str], tasks_of_leaf: int = TASKS_OF_LEAF
) -> DataFrame:
    """The table of all linked pairs (docs has key and text): for each bucket a minimal
    perfect hash, and in its order the pairs, their counts (64 bits) and whether the count
    is the highest of the pair's second id (a bit each). Stored.

    A bucket holds at most the pairs of its second ids, so its size is bounded by the
    vocabularies, whatever the corpus.
    """
    v = vocabularies(*paths)
    v_kind, mask = v.kind.str, v.mask
    partial = staged_rows(_partial_counts(docs, paths, tasks_of_leaf), "pair-partials")
    leaves = partial.groupBy("bucket", "leaf").applyInArrow(_merged_counts(v_kind), _COUNTS)
    leaves = staged_rows(leaves, "pair-leaves")

    def union(table: pa.Table) -> pa.Table:
        pairs = np.unique(np.frombuffer(b"".join(table.column("pairs").to_pylist()), v_kind))
        first = table.select(["bucket", "leaf"]).slice(0, 1)
        return first.append_column("pairs", pa.array([pairs.tobytes()], pa.binary()))

    def hashed(table: pa.Table) -> pa.Table:
        pairs = np.frombuffer(b"".join(table.column("pairs").to_pylist()), v_kind)
        index, slots = build(*_hashes(pairs))
        ordered = np.empty_like(pairs)
        ordered[slots] = pairs
        return pa.Table.from_arrays(
            [
                table.column("bucket").slice(0, 1),
                pa.array([index], pa.binary()),
                pa.array([ordered.tobytes()], pa.binary()),
            ],
            names=["bucket", "index", "pairs"],
        )

    distinct = _tree(leaves.drop("counts"), _DISTINCT, "pair-distinct", union)
    index = staged_rows(distinct.groupBy("bucket").applyInArrow(hashed, _HASHED), "pair-index")

    def dense(counted: pa.Table, index: pa.Table) -> pa.Table:
        """A leaf's counts as a vector in the order of the bucket's hash."""
        pairs = np.frombuffer(counted.column("pairs")[0].as_py(), v_kind)
        held = np.frombuffer(index.column("pairs")[0].as_py(), v_kind)
        vector = np.zeros(len(held), "<i8")
        slots = _verified(index.column("index")[0].as_py(), held, pairs)
        vector[slots] = np.frombuffer(counted.column("counts")[0].as_py(), "<i8")
        first = counted.select(["bucket", "leaf"]).slice(0, 1)
        return first.append_column("vector", pa.array([vector.tobytes()], pa.binary()))

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in table.column("vector"))
        first = table.select(["bucket", "leaf"]).slice(0, 1)
        return first.append_column("vector", pa.array([total.tobytes()], pa.binary()))

    # Each leaf of a bucket gets the bucket's index.
    each = leaves.select("bucket", F.col("leaf").alias("of")).join(index, "bucket")
    each = each.select(F.col("bucket").alias("to"), "of", "index", "pairs").groupBy("to", "of")
    vectors = leaves.groupBy("bucket", "leaf").cogroup(each).applyInArrow(dense, _VECTOR)
    total = _tree(staged_rows(vectors, "pair-vectors"), _VECTOR, "pair-sums", add)

    def finished(vector: pa.Table, index: pa.Table) -> pa.Table:
        counts = np.frombuffer(vector.column("vector")[0].as_py(), "<i8")
        seconds = np.frombuffer(index.column("pairs")[0].as_py(), v_kind) & mask
        highest = np.zeros(int(seconds.max()) + 1, np.int64)
        np.maximum.at(highest, seconds, counts)
        best = np.packbits(counts == highest[seconds])
        return pa.Table.from_arrays(
            [
                *index.select(["bucket", "index", "pairs"]).columns,
                pa.array([counts.tobytes()], pa.binary()),
                pa.array([best.tobytes()], pa.binary()),
            ],
            names=["bucket", "index", "pairs", "counts", "best"],
        )

    both = total.groupBy("bucket").cogroup(index.groupBy("bucket"))
    return staged_rows(both.applyInArrow(finished, _TABLE), "pair-counts")


def _hashes(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = pairs.astype(np.uint64)
    return _mixed(wide), _mixed(wide + np.uint64(0x9E3779B97F4A7C15))


def _verified(index: bytes, held: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The slots of pairs that are all in the index."""
    slots = slots_of(index, *_hashes(pairs))
    if (slots < 0).any() or not np.array_equal(held[slots], pairs):
        raise KeyError("a pair is not in the index")
    return slots


class PairTable:
    """The table of pairs, or some buckets of it, for looking counts up."""

    def __init__(self, rows: Sequence[tuple], v_kind: str, mask: int):
        self.mask = mask
        self.buckets = {}
        for bucket, index, pairs, counts, best in rows:
            held = np.frombuffer(pairs, v_kind)
            bits = np.unpackbits(np.frombuffer(best, np.uint8), count=len(held)).astype(bool)
            self.buckets[bucket] = (bytes(index), held, np.frombuffer(counts, "<i8"), bits)

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each pair, and whether it is its second id's highest; 0 and False
        for a pair that the table does not hold, as the stored pair at its slot tells."""
        distinct, back = np.unique(pairs, return_inverse=True)
        counts, best = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), bool)
        for bucket, at in _by_bucket(distinct, self.mask):
            if bucket not in self.buckets:
                continue
            index, held, stored, bits = self.buckets[bucket]
            slots = slots_of(index, *_hashes(distinct[at]))
            known = (slots >= 0) & (held[slots] == distinct[at])
            at, slots = at[known], slots[known]
            counts[at], best[at] = stored[slots], bits[slots]
        return counts[back], best[back]


# --- the second pass: counts looked up


class _Kept:
    """For each word its numbers of tokens, groups and links, and its groups as text."""

    texts = True

    def __init__(self, pairs: PairTable | None):
        self.pairs = pairs
        self.clear()

    def clear(self):
        self.numbers = np.zeros((0, 7), np.int64)
        self.groups: list[str] = []
        self.links: list[np.ndarray] = []

    def add(self, a: Aligned):
        ends = np.cumsum(a.links)
        columns = [a.tokens_a, a.tokens_b, a.groups, a.links]
        if self.pairs is not None:
            counts, best = self.pairs.look_up(a.pairs)
            # Words of texts without tokens are not in the table; no other text may miss any.
            values = (best.astype(np.int64), counts, (counts == 0).astype(np.int64))
            columns += [_sums(x, ends) for x in values]
        else:
            columns += [np.zeros(len(ends), np.int64)] * 3
            self.links += np.split(a.pairs, ends[:-1])
        self.numbers = np.concatenate([self.numbers, np.stack(columns, axis=1)])
        self.groups += a.texts


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the stretches that end before each of ends."""
    through = np.concatenate([[0], np.cumsum(values)])
    return np.diff(through[ends], prepend=0)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _described(kept: _Kept, documents: list[np.ndarray], whole: bool) -> dict[str, list]:
    """The columns of a slice's documents."""
    numbers = np.array([kept.numbers[words].sum(axis=0) for words in documents]).reshape(-1, 7)
    if numbers[:, 6].any():
        raise KeyError("a pair is not in the index")
    texts = [";".join([kept.groups[i] for i in words.tolist()]) for words in documents]
    columns = {name: numbers[:, i].tolist() for i, name in enumerate(_NUMBERS)}
    columns["groups_sha256"] = [sha256(t.encode()).hexdigest() if t else "" for t in texts]
    return columns | ({"groups": texts} if whole else {})


def aligned_documents(
    docs: DataFrame,
    paths: tuple[str, str],
    key: str = "doc_id",
    text: str = "text",
    whole: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    tasks_of_leaf: int = TASKS_OF_LEAF,
) -> DataFrame:
    """Key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    ``paths``: a byte-level tokenizer of the tokenizers library, whose texts get a blank in
    front, and a merge-type sentencepiece model, which adds it. ``whole`` adds ``groups``,
    as in ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts whose tokens on either side do not give the text's
    bytes back, have no tokens: zeros and ''. Repeated rows count, and are returned, each;
    a null key stays; a text of any length is taken whole; ties for the highest count are
    all best; other columns, of any name, are not read; an empty table gives no rows.
    """
    rows = keyed_text(docs, key, text)
    pairs = pair_counts(rows, paths, tasks_of_leaf)
    sizes = [F.octet_length(c) for c in ("index", "pairs", "counts", "best")]
    total = pairs.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0
    names = [*(f"{n} long" for n in _NUMBERS), "groups_sha256 string", *(["groups string"] if whole else [])]
    schema = keyed_schema(rows, "key", ", ".join(names))
    if total <= broadcast_bytes:
        found = _looked_up_here(rows, pairs, paths, schema, whole)
    else:
        found = _looked_up_there(rows, pairs, paths, schema, whole, tasks_of_leaf)
    return found.select(F.col("key").alias(key), *schema.fieldNames()[1:])


def _looked_up_here(rows, pairs, paths, schema, whole) -> DataFrame:
    """Each task has the whole table of pairs, whose size was checked."""
    stored = pairs.sparkSession.sparkContext.broadcast([tuple(map(_plain, r)) for r in pairs.collect()])
    kind = arrow_schema(schema)

    def task(batches):
        v = vocabularies(*paths)
        kept = _Kept(PairTable(stored.value, v.kind.str, v.mask))
        memory = Memory(v, kept)
        for part in slices(batches):
            columns = _described(kept, memory.documents(part.column("text").to_pylist()), whole)
            yield _batch(columns | {"key": part.column("key")}, kind)
            if memory.full():
                memory.clear()
                kept.clear()

    return rows.mapInArrow(task, schema)


def _plain(value):
    return bytes(value) if isinstance(value, bytearray) else value


def _batch(columns: dict, kind: pa.Schema) -> pa.RecordBatch:
    arrays = [
        x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f in kind for x in [columns[f.name]]
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=kind)


def _looked_up_there(rows, pairs, paths, schema, whole, tasks_of_leaf) -> DataFrame:
    """The pairs of each slice of documents go to the buckets, and sums come back.

    A row has a number of its own, written with its pairs in one table, so that no retry
    can tell them apart. A bucket is split among leaves of tasks, each of which meets the
    bucket's index first and then its slices one by one.
    """
    dealt = "bucket int, leaf int, row long, rows binary, linked binary, times binary"
    first = StructType([*schema.fields, *StructType.fromDDL(dealt).fields])
    kind = arrow_schema(first)

    def task(batches):
        v = vocabularies(*paths)
        kept = _Kept(None)
        memory = Memory(v, kept)
        at = TaskContext.get().partitionId()
        leaf, row = at // tasks_of_leaf, at << 40
        for part in slices(batches):
            documents = memory.documents(part.column("text").to_pylist())
            columns = _described(kept, documents, whole) | {"key": part.column("key")}
            columns["row"] = list(range(row, row + len(documents)))
            empty = {f.name: pa.nulls(len(documents), f.type) for f in kind}
            yield _batch(empty | columns, kind)
            # Each document's distinct pairs, as (place in the slice, pair, times).
            found = [_document_links(kept.links, words, v.kind) for words in documents]
            places = np.repeat(np.arange(len(found), dtype="<u4"), [len(x) for x, _ in found])
            linked = np.concatenate([x for x, _ in found]) if found else np.zeros(0, v.kind)
            times = np.concatenate([x for _, x in found]) if found else np.zeros(0, "<i8")
            packed = [
                (b, places[i].tobytes(), linked[i].tobytes(), times[i].astype("<i8").tobytes())
                for b, i in _by_bucket(linked, v.mask)
            ]
            if packed:
                empty = {f.name: pa.nulls(len(packed), f.type) for f in kind}
                names = ("bucket", "rows", "linked", "times")
                sent = dict(zip(names, map(list, zip(*packed))))
                sent |= {"leaf": [leaf] * len(packed), "row": [row] * len(packed)}
                yield _batch(empty | sent, kind)
            row += len(documents)
            if memory.full():
                memory.clear()
                kept.clear()

    written = staged_rows(rows.mapInArrow(task, first), "pair-documents")
    sent = written.where("bucket is not null").select("bucket", "leaf", "row", "rows", "linked", "times")
    tables = sent.select("bucket", "leaf").distinct().join(pairs, "bucket")
    both = sent.unionByName(tables, allowMissingColumns=True)
    both = both.repartition("bucket", "leaf").sortWithinPartitions("bucket", "leaf", F.col("index").isNull())
    v = vocabularies(*paths)
    v_kind, mask = v.kind.str, v.mask
    sums = "row long, n_best long, count_sum long"
    out = arrow_schema(sums)

    def look_up(batches):
        table, of = None, None
        for part in slices(batches, 64):
            for r in part.to_pylist():
                if r["index"] is not None:
                    stored = tuple(r[c] for c in ("bucket", "index", "pairs", "counts", "best"))
                    table, of = PairTable([stored], v_kind, mask), (r["bucket"], r["leaf"])
                    continue
                if of != (r["bucket"], r["leaf"]):
                    raise AssertionError("each bucket's index comes before its pairs")
                counts, best = table.look_up(np.frombuffer(r["linked"], v_kind))
                if not counts.all():
                    raise KeyError("a pair is not in the index")
                times, places = np.frombuffer(r["times"], "<i8"), np.frombuffer(r["rows"], "<u4")
                numbers, start = np.unique(places, return_index=True)
                columns = {
                    "row": (r["row"] + numbers.astype(np.int64)).tolist(),
                    "n_best": np.add.reduceat(best * times, start).tolist(),
                    "count_sum": np.add.reduceat(counts * times, start).tolist(),
                }
                yield _batch(columns, out)

    sums = both.mapInArrow(look_up, sums).groupBy("row")
    sums = sums.agg(F.sum("n_best").alias("best"), F.sum("count_sum").alias("total"))
    documents = written.where("bucket is null").join(sums, "row", "left")
    summed_up: dict[str, Column] = {
        "n_best": F.coalesce("best", F.lit(0)),
        "count_sum": F.coalesce("total", F.lit(0)),
    }
    return documents.withColumns(summed_up).select(*schema.fieldNames())


def _document_links(links: list[np.ndarray], words: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct pairs and how often each is linked."""
    each = [links[i] for i in words.tolist()]
    found = np.concatenate(each) if each else np.zeros(0, kind)
    return np.unique(found, return_counts=True)

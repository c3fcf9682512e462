"""Operator 9: exact encoding and decoding with a merge-type SentencePiece vocabulary.

A token sequence is what merging gives if and only if each adjacent pair of its tokens,
merged again on its own, stays that pair. So the encoder walks the text with the longest
vocabulary match at each place (Aho-Corasick over the reversed text finds all matches
that start there), keeps a match if it is compatible with the token before it, tries the
next shorter one if not, and steps back when none is left. A place that has failed once
fails always, since the tokens before it are unique; a bit field remembers those places.

Signs that pieces have at their start only (blanks, most punctuation) cut a text into
parts that are encoded apart; each Python worker remembers a fixed number of them. No
row needs another: no shuffle.
"""

from __future__ import annotations

import re
import string
import struct
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.llm.rows import Recent, kept_by, keyed_schema, keyed_text, map_rows

BLANK = "▁"
#: Cuts a text before each sign that no piece has but at its start.
CUT = "\x01"
#: A run of blanks with the word after it.
_RUNS = re.compile(" *[^ ]+| +")
#: Parts of texts that a worker remembers, and token pairs.
CACHED_PARTS = 400_000
CACHED_PAIRS = 500_000
#: Places whose matches are held at a time while a long word is encoded.
BLOCK = 4096


class MergeEncoder:
    """Encodes as the library does for merge-type models with byte fallback."""

    def __init__(self, path: str, cached: int = CACHED_PARTS):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        kinds = (lib.is_control, lib.is_unknown, lib.is_byte, lib.is_unused)
        self.id = {
            lib.id_to_piece(i): i for i in range(size) if not any(kind(i) for kind in kinds)
        }
        self.score = {p: lib.get_score(i) for p, i in self.id.items()}
        self.byte = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id), default=1)
        self.texts = {i: p for p, i in self.id.items()}
        self.found = ahocorasick.Automaton()
        for piece, i in self.id.items():
            # A piece that merging never makes (no two parts of it are pieces) is no match.
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.found.add_word(piece[::-1], (len(piece), i))
        self.found.make_automaton()
        self.words_apart = not any(BLANK in p.lstrip(BLANK) for p in self.id)
        self.prefix = self._blank_added()
        self.pairs: dict[int, bool] = {}
        inner = set().union(*(p[1:] for p in self.id)) - {BLANK}
        self.openers = [c for c in [*string.punctuation, "\n", "\t", " "] if c not in inner]
        self.parts = Recent(self._ids, cached)

    def _blank_added(self) -> bool:
        """Whether a text gets a blank in front; other changes of the text are refused."""
        probe = self.library.normalize("a  B")
        if probe not in ("a  B".replace(" ", BLANK), BLANK + "a  B".replace(" ", BLANK)):
            raise ValueError("only vocabularies that leave the text as it is can be read")
        return probe[0] == BLANK

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short text: the best pair first, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the two tokens stay two when merged again. Below 0: a lone character."""
        left = self.texts[a] if a >= 0 else chr(-1 - a)
        right = self.texts[b] if b >= 0 else chr(-1 - b)
        fits = self.merged(left + right) == [left, right]
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[(a << 32) | (b & 0xFFFFFFFF)] = fits
        return fits

    def _matches(self, word: str, block: int) -> list[list[tuple[int, int]]]:
        """For each place of a block, the pieces that start there, the longest first."""
        low = block * BLOCK
        high = min(len(word), low + BLOCK)
        turned = word[low : high + self.longest - 1][::-1]
        starts: list[list[tuple[int, int]]] = [[] for _ in turned]
        for end, match in self.found.iter(turned):
            starts[end].append(match)
        return starts[::-1]

    def tokens(self, word: str) -> list[int]:
        """Tokens of a word by backtracking; below 0: a character without a piece."""
        n, failed, pairs = len(word), bytearray(len(word) // 8 + 1), self.pairs
        block, starts = -1, []
        taken: list[tuple[int, int, int]] = []  # place, number of the match, token
        place = at = 0
        while place < n:
            if place // BLOCK != block:
                block = place // BLOCK
                starts = self._matches(word, block)
            matches = starts[place % BLOCK]
            if not matches or matches[-1][0] > 1:
                matches.append((1, -1 - ord(word[place])))
            last = taken[-1][2] if taken else None
            for i in range(at, len(matches)):
                length, token = matches[i]
                end = place + length
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if last is not None:
                    fits = pairs.get((last << 32) | (token & 0xFFFFFFFF))
                    if fits is None:
                        fits = self._compatible(last, token)
                    if not fits:
                        continue
                taken.append((place, i, token))
                place, at = end, 0
                break
            else:
                if not taken:
                    raise AssertionError("merging gives a sequence for every text")
                failed[place >> 3] |= 1 << (place & 7)
                place, at, _ = taken.pop()
                at += 1
        return [token for _, _, token in taken]

    def _ids(self, part: str) -> bytes:
        """Ids of a part of a text, whose blanks are plain ones: a memory of it is smaller."""
        ids: list[int] = []
        for token in self.tokens(part.replace(" ", BLANK)):
            if token >= 0:
                ids.append(token)
            else:
                ids += (self.byte[b] for b in chr(-1 - token).encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, little-endian, 32 bits each; null counts as empty."""
        if not text:
            return b""
        # The library tells blanks and their sign in a text apart no more than we do.
        whole = (" " if self.prefix else "") + text.replace(BLANK, " ")
        if not self.words_apart:
            return self._ids(whole)
        if "  " in whole or CUT in whole:
            parts = _RUNS.findall(whole)
        else:
            for sign in self.openers:
                if sign in whole:
                    whole = whole.replace(sign, CUT + sign)
            parts = whole.split(CUT)
        return b"".join(map(self.parts.__getitem__, parts))

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@kept_by(__name__)
@lru_cache(maxsize=2)
def encoder(path: str) -> MergeEncoder:
    """One for each Python worker, kept between its tasks until another operator's."""
    return MergeEncoder(path)


def encode_decode(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", ends: bool = True
) -> DataFrame:
    """Key, ids (binary, little-endian 32 bits) and the decoded text of each row.

    ends adds the begin and end ids. A null or empty text has the end ids alone and
    decodes to an empty text; a null key stays; repeated rows are encoded each; an empty
    table gives no rows; other columns are not read. Characters without a piece become
    byte pieces. A text of any length is taken whole, a long word block by block.
    """
    return _coded(docs, model, key, text, ends, "ids binary, decoded string", _ids_and_text)


def encode_decode_digests(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", ends: bool = True
) -> DataFrame:
    """Key, n_tokens, ids_sha256 and decoded_sha256 of what encode_decode gives.

    The digests are taken in the task, so that ids and texts need not leave it.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _coded(docs, model, key, text, ends, schema, _digests)


def _ids_and_text(ids: list[bytes], texts: list[str]) -> dict:
    return {"ids": ids, "decoded": texts}


def _digests(ids: list[bytes], texts: list[str]) -> dict:
    return {
        "n_tokens": [len(x) // 4 for x in ids],
        "ids_sha256": [sha256(x).hexdigest() for x in ids],
        "decoded_sha256": [sha256(x.encode()).hexdigest() for x in texts],
    }


def _coded(docs, model, key, text, ends, schema, finish) -> DataFrame:
    def start():
        codec = encoder(model)
        lib = codec.library
        first = np.array([lib.bos_id()] if ends else [], "<u4").tobytes()
        last = np.array([lib.eos_id()] if ends else [], "<u4").tobytes()

        def one(part):
            ids = [first + codec.encode(t) + last for t in part.column("text").to_pylist()]
            return {"key": part.column("key")} | finish(ids, [codec.decode(x) for x in ids])

        return one

    rows = map_rows(keyed_text(docs, key, text), keyed_schema(docs, key, schema), start)
    return rows.select(F.col("key").alias(key), *rows.columns[1:])

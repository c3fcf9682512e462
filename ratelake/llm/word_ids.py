"""Ids of a word vocabulary file, by the tokenizers library, word by word.

The vocabulary drops white space and merges nothing over it, so a text is encoded blank
by blank and each Python worker remembers a fixed number of words. A plain word (letters
of Latin-1, then ASCII signs) is normalised here as the library normalises it and given
to the library's merge model; anything else passes the library's whole pipeline.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from ratelake.llm.rows import Remembered
from ratelake.llm.token_counts import byte_characters

CACHED_WORDS = 900_000
_LATIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+").fullmatch
#: A comma or full stop after anything but a letter or digit that normalising leaves alone.
#: Elsewhere the sign may join what stands before it: a run of signs, or the mark that a
#: letter ends in once it is decomposed or made lower case.
_JOINED = re.compile("[,.] (?<![0-9a-zA-ZÀ-ÖØ-öø-ÿ]..)").search


class WordEncoder:
    def __init__(self, path: str, cached: int = CACHED_WORDS):
        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.letters = dict(enumerate(byte_characters()))
        self.words = Remembered(self._word, cached)
        self.plain = Remembered(self._plain, cached)
        self.signs = Remembered(self._whole, cached)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _plain(self, word: str) -> bytes:
        """A lower-case word of letters: only merges are left to do."""
        signs = word.encode().decode("latin-1").translate(self.letters)
        return self._packed([token.id for token in self.merge(signs)])

    def _whole(self, word: str) -> bytes:
        return self._packed(self.library.encode(word, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """Letters and the signs after them are apart for the vocabulary's pattern."""
        core = word.rstrip(string.punctuation)
        if not core or not _LATIN(core):
            return self._whole(word) if word else b""
        tail = word[len(core) :]
        return self.plain[core.lower()] + (self.signs[tail] if tail else b"")

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text in the width of the vocabulary; null counts as empty."""
        if not text:
            return b""
        text = text.replace("\n", " ")
        if not _JOINED(text):
            text = text.replace(", ", " , ").replace(". ", " . ")
        return b"".join(map(self.words.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept between its tasks."""
    return WordEncoder(path)

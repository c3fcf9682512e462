"""Operator 10: language of texts, and of the spans of mixed texts.

Learning counts hashed character n-grams of words per language over all labelled rows; a
task adds up its own words first and sends at most one row for each language and bucket,
so the model has a fixed size for each language. Prediction gives each word a score per
language: the script of its letters narrows the candidates, its n-grams weigh them. A
Viterbi pass over the words, with a penalty for each switch, labels spans. The language
with most letters is the prediction.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.llm.rows import arrow_schema, keyed_schema, keyed_text, map_batches, map_rows, slices

#: Buckets of n-grams; the model holds languages x buckets counts.
BUCKETS = 1 << 15
#: Languages beyond which the model would outgrow a broadcast (128 kB for each).
MOST_LANGUAGES = 512
#: Words counted in a task before they are added to the buckets.
COUNTED_WORDS = 300_000
#: Words whose scores a task remembers.
CACHED_WORDS = 600_000
#: Letters of the words whose n-grams are hashed at once.
HASHED_LETTERS = 250_000
#: Texts that are labelled in step.
LABELLED_ROWS = 4096
#: Words times languages of the mixed texts that are labelled together, and n-grams times
#: languages of the words that are scored together.
CELLS = 8_000_000
#: Cost of a change of language between two words, in nats, and n-gram weight: the
#: n-grams of a word overlap, so their evidence is divided.
SWITCH = 8.0
WEIGHT = 0.4
SMOOTHING = 0.5
#: A script belongs to a language if this share of its training words is written in it.
SCRIPT_SHARE = 0.005

#: Script ranges by first code point (fixed values of the Unicode blocks); "" is no script.
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"),
    (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"),
    (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"),
    (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Other"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_STARTS = np.array([start for start, _ in SCRIPT_STARTS])
_SCRIPT_AT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])
#: Buckets of so many zero bytes; three characters have twelve at most.
_ZEROS = np.array([zlib.crc32(bytes(n)) % BUCKETS for n in range(13)], np.int32)
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(word: str) -> list[str]:
    """The runs of letters; ½, ② and Ⅷ are word characters to a pattern, but no letters."""
    if word.isalpha():
        return [word]
    runs = _LETTERS.findall(word)
    if all(map(str.isalpha, runs)):
        return runs
    return "".join(c if c.isalpha() else " " for c in word).split()


def spaced(text: str | None) -> str:
    """Lower case, with the commonest signs set off from their words."""
    return (text or "").lower().replace(",", " ").replace(".", " ")


def bulks(words: Iterable[str]) -> Iterator[list[str]]:
    """Cuts words into lists of HASHED_LETTERS; a longer word stays whole."""
    some, letters = [], 0
    for word in words:
        some.append(word)
        letters += len(word)
        if letters >= HASHED_LETTERS:
            yield some
            some, letters = [], 0
    if some:
        yield some


def hashed(runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The script of each run's first letter, its number of n-grams, and the buckets of the
    one to three character n-grams of all runs with their edges, run after run.

    An n-gram's bucket is its crc32 cut to the bits of BUCKETS. crc32 of a string is that
    of as many zeros, changed by each of its characters on its own: by how crc32 of the
    character with zeros for what follows differs from that of zeros alone. So a few
    numbers for each character that occurs give all n-grams at once.
    """
    coded = "".join([f"^{run}$" for run in runs]).encode("utf-32-le", "replace")
    codes = np.frombuffer(coded, np.uint32)
    size = np.fromiter(map(len, runs), np.int64, len(runs)) + 2
    begin = np.cumsum(size) - size
    script = _SCRIPT_AT[np.searchsorted(_STARTS, codes[begin + 1], side="right") - 1]
    alphabet = np.flatnonzero(np.bincount(codes))
    spelt = [chr(c).encode() for c in alphabet]
    lengths = np.array([len(c) for c in spelt], np.int32)
    # By the bytes that follow: two characters have eight at most.
    alone = np.array([[zlib.crc32(c + bytes(n)) % BUCKETS for c in spelt] for n in range(9)])
    alone = alone.astype(np.int32) ^ _ZEROS[lengths + np.arange(9)[:, None]]
    place = np.zeros(alphabet[-1] + 1, np.int32)
    place[alphabet] = np.arange(len(alphabet))
    at = place[codes]
    last, width = alone[0][at], lengths[at]
    two = width[:-1] + width[1:]
    middle = alone[width[1:], at[:-1]] ^ last[1:]
    first = alone[two[1:], at[:-2]] ^ middle[1:]
    found = (_ZEROS[width] ^ last, _ZEROS[two] ^ middle, _ZEROS[width[:-2] + two[1:]] ^ first)
    # A run of m signs has m n-grams of one, m - 1 of two and m - 2 of three.
    count = 3 * size - 3
    buckets = np.empty(count.sum(), np.int32)
    inside = np.arange(len(codes)) - np.repeat(begin, size)
    left = np.repeat(size, size) - inside
    to = np.repeat(np.cumsum(count) - count, size) + inside
    for n, grams in enumerate(found):
        fits = left[: len(grams)] > n
        # The n-grams of n characters come after those of fewer.
        buckets[to[: len(grams)][fits]] = grams[fits]
        to += np.repeat(size - n, size)
    return script, count, buckets


def in_holdout(key: str | Column) -> Column:
    """Whether crc32 of the key as text is divisible by five; a null key counts as ''."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "utf-8")) % 5 == 0


@dataclass(frozen=True)
class LanguageModel:
    """languages: sorted labels; scores: languages x buckets; scripts: languages x scripts."""

    languages: list[str]
    scores: np.ndarray
    scripts: np.ndarray


def learn(labelled: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel:
    """Counts over all rows that have a label and a text; other rows are left out.

    Repeated rows count again. A table without such rows gives a model without languages,
    which predicts 'und'. More than MOST_LANGUAGES labels raise an error.
    """
    schema = "label string, bucket int, n long"
    out = arrow_schema(schema)

    def task(batches):
        counts: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def add():
            for lang, counter in words.items():
                sums = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                for some in bulks(counter):
                    lists = [letter_runs(word) for word in some]
                    runs = [run for runs in lists for run in runs]
                    if runs:
                        script, count, buckets = hashed(runs)
                        times = np.repeat([counter[word] for word in some], list(map(len, lists)))
                        np.add.at(sums, BUCKETS + script, times)
                        np.add.at(sums, buckets, np.repeat(times, count))
            words.clear()

        for part in slices(batches):
            for lang, t in zip(part["label"].to_pylist(), part["text"].to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(spaced(t).split())
            if sum(map(len, words.values())) > COUNTED_WORDS:
                add()
        add()
        for lang, sums in counts.items():
            (at,) = np.nonzero(sums)
            columns = [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums[at])]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    rows = labelled.select(F.col(f"`{label}`").alias("label"), F.col(f"`{text}`").alias("text"))
    counted = map_batches(rows.where("label is not null and text is not null"), task, schema)
    sums = counted.groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    # At most languages x (buckets + scripts) rows reach the driver, however many texts.
    most = MOST_LANGUAGES * (BUCKETS + len(SCRIPTS))
    known = sums.limit(most + 1).toPandas()
    languages = sorted(known["label"].unique())
    if len(languages) > MOST_LANGUAGES or len(known) > most:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    place = {lang: i for i, lang in enumerate(languages)}
    table[known["label"].map(place).to_numpy(int), known["bucket"].to_numpy(int)] = known["n"]
    seen, scripts = table[:, :BUCKETS] + SMOOTHING, table[:, BUCKETS:]
    shares = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
    logs = np.log(seen / seen.sum(axis=1, keepdims=True))
    return LanguageModel(languages, logs.astype(np.float32), shares >= SCRIPT_SHARE)


class _Places(dict):
    """A place for each word, in the order in which they come; new ones are listed."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class _Labeller:
    """Scores words and labels the words of many texts at once."""

    def __init__(self, model: LanguageModel, switch: float):
        self.model, self.switch = model, switch
        self.by_bucket = np.ascontiguousarray(model.scores.T)
        self.clear()

    def clear(self) -> None:
        self.place = _Places()
        self.rows = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int64)
        self.used = 0

    def _add(self, words: list[str]) -> None:
        """Scores the words that have come to the places after those in use."""
        n = len(words)
        while self.used + n > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        for some in bulks(words):
            self._score(some)
            self.used += len(some)

    def _score(self, words: list[str]) -> None:
        lists = [letter_runs(word) for word in words]
        known = [i for i, runs in enumerate(lists) if runs]
        if not known:
            return
        parts = np.array([len(lists[i]) for i in known])
        begin = np.cumsum(parts) - parts
        runs = [run for runs in lists for run in runs]
        at = self.used + np.array(known)
        self.letters[at] = np.add.reduceat(list(map(len, runs)), begin)
        if not self.model.languages:
            return
        script, count, buckets = hashed(runs)
        count = np.add.reduceat(count, begin)
        ends = np.cumsum(count)
        score = np.empty((len(known), len(self.model.languages)), np.float32)
        low, most = 0, max(1, CELLS // len(self.model.languages))
        while low < len(known):
            # As many words as have so many n-grams, one at least.
            start = ends[low] - count[low]
            high = max(low + 1, np.searchsorted(ends, start + most, side="right"))
            part = self.by_bucket[buckets[start : ends[high - 1]]]
            np.add.reduceat(part, ends[low:high] - count[low:high] - start, axis=0, out=score[low:high])
            low = high
        score *= np.float32(WEIGHT)
        # A word is of the script of its first letter.
        may = self.model.scripts.T[script[begin]]
        # Outside the script's languages a word is as bad as many of its n-grams; a
        # script that no language has tells nothing.
        least = np.where(may, score, np.inf).min(axis=1, keepdims=True) - 20
        score = np.where(may, score, least)
        score[~may.any(axis=1)] = 0
        self.rows[at] = score - score.max(axis=1, keepdims=True)

    def words(self, texts: list[str | None]) -> list[np.ndarray]:
        """The words of each text, by their rows."""
        place = self.place.__getitem__
        split = (spaced(t).split() for t in texts)
        found = [np.fromiter(map(place, words), np.int64, len(words)) for words in split]
        self._add(self.place.new)
        self.place.new = []
        return found

    def labels(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The best language of each word of each text."""
        out: list = [self._single(words) for words in texts]
        mixed: list[int] = []
        cells = 0
        for i, words in enumerate(texts):
            if out[i] is None:
                mixed.append(i)
                cells += len(words) * len(self.model.languages)
            if mixed and (cells > CELLS or i == len(texts) - 1):
                for j, label in zip(mixed, self._viterbi([texts[j] for j in mixed]), strict=True):
                    out[j] = label
                mixed, cells = [], 0
        return out

    def _single(self, words: np.ndarray) -> np.ndarray | None:
        """One language for all words if that is the best labelling for certain.

        It is if no stretch of words gains more than one switch costs in any other
        language, and a first and a last stretch together do not either: stretches beside
        some of the language cost a switch each at least, and k that cover the whole text
        cost k - 1; a single one gains nothing, as the language has the best sum.
        """
        if not len(words) or len(self.model.languages) < 2:
            return np.zeros(len(words), np.int16)
        score = self.rows[words].astype(np.float64)
        top = int(score.sum(axis=0).argmax())
        gain = np.cumsum(score - score[:, top : top + 1], axis=0)
        # The largest gain of a stretch: a sum less the least sum before it.
        least = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
        least = np.vstack([np.zeros((1, gain.shape[1])), least[:-1]])
        ends = max(0.0, gain.max()) + (gain[-1] - least[-1]).max()
        if max((gain - least).max(), ends) <= self.switch:
            return np.full(len(words), top, np.int16)
        return None

    def _viterbi(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi in step over all texts, longest first."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order])
        out = [np.zeros(len(t), np.int16) for t in texts]
        steps = int(sizes[0]) if len(sizes) else 0
        if not steps or len(self.model.languages) < 2:
            return out
        padded = np.concatenate([texts[i] for i in order])
        begin = np.cumsum(sizes) - sizes
        best, back = None, []
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")
        kinds = np.arange(len(self.model.languages), dtype=np.int16)
        last_best = np.zeros((len(order), len(kinds)), np.float64)
        for t in range(steps):
            n = active[t]
            score = self.rows[padded[begin[:n] + t]]
            if best is None:
                best = score.astype(np.float64)
                back.append(None)
            else:
                before = best[:n]
                top = before.argmax(axis=1)
                change = before[np.arange(n), top] - self.switch
                stay = before >= change[:, None]
                back.append(np.where(stay, kinds, top[:, None].astype(np.int16)))
                best = score + np.where(stay, before, change[:, None])
                # Only differences count, so sums stay small on texts of any length.
                best -= best.max(axis=1, keepdims=True)
            last_best[:n] = best
        label = last_best.argmax(axis=1).astype(np.int16)
        flat = np.zeros(len(padded), np.int16)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            flat[begin[:n] + t] = label[:n]
            if t:
                label[:n] = back[t][np.arange(n), label[:n]]
        for i, start, size in zip(order, begin, sizes, strict=True):
            out[i] = flat[start : start + size]
        return out


def language_spans(
    docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text",
    switch: float = SWITCH, with_text: bool = False,
) -> DataFrame:
    """Key, lang_pred, score (0 to 1) and spans (first word, words, language) of each row.

    with_text returns the text too, so that it need not travel in the key.

    lang_pred has the most letters in the text; equal counts go to the first label in
    order. score is its share of the letters times the weight of the evidence for it over
    the whole text. A null text, one without letters and a model without languages give
    'und', score 0 and no spans. Words without letters take the language around them.
    Repeated rows are labelled each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 128 kB a language
    spans_kind = "array<struct<first:int,words:int,lang:string>>"
    rest = f"lang_pred string, score double, spans {spans_kind}"
    schema = keyed_schema(docs, key, rest + (", text string" if with_text else ""))

    def start():
        labeller = _Labeller(shared.value, switch)
        names = shared.value.languages

        def one(part):
            if labeller.used > CACHED_WORDS:
                labeller.clear()
            texts = labeller.words(part["text"].to_pylist())
            preds, scores, spans = [], [], []
            for words, label in zip(texts, labeller.labels(texts), strict=True):
                letters = labeller.letters[words] if len(words) else np.zeros(0, np.int64)
                if not names or not letters.sum():
                    preds.append("und"), scores.append(0.0), spans.append([])
                    continue
                held = np.bincount(label, weights=letters, minlength=len(names))
                top = int(held.argmax())
                whole = labeller.rows[words].sum(axis=0, dtype=np.float64)
                odds = np.exp(np.clip(whole - whole[top], -700, 700))
                odds[top] = 1.0
                weight = 1.0 / odds[odds <= 1].sum() if (odds <= 1).all() else 0.5
                preds.append(names[top])
                scores.append(float(min(1.0, held[top] / letters.sum() * weight)))
                cuts = np.flatnonzero(np.diff(label)) + 1
                firsts = [0, *cuts.tolist()]
                ends = [*cuts.tolist(), len(label)]
                spans.append(
                    [
                        {"first": a, "words": b - a, "lang": names[label[a]]}
                        for a, b in zip(firsts, ends, strict=True)
                    ]
                )
            found = {"key": part["key"], "lang_pred": preds, "score": scores, "spans": spans}
            return found | ({"text": part["text"]} if with_text else {})

        return one

    rows = map_rows(keyed_text(docs, key, text), schema, start, rows=LABELLED_ROWS)
    return rows.select(F.col("key").alias(key), *rows.columns[1:])

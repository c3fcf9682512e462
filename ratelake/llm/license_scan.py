"""Operator 2: licence texts and notices in documents, by patience alignment.

Words that occur once in a stretch of text and once in a template are anchors; the longest
increasing subsequence of their places is kept, equal words next to anchors join them, and
the gaps between are aligned the same way. A gap without such words takes the longest
common subsequence. The matched share of the template's words is its coverage.

A stretch of text is aligned only if it holds enough of the template's words, counted with
their multiplicity, to reach the coverage asked for; that loses nothing and passes over
most texts after one look-up for each word. The templates are a parameter whose number of
words is checked, so they are sent to all tasks; documents are not shuffled.
"""

from __future__ import annotations

import json
import pkgutil
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratelake.llm.rows import arrow_schema, keyed_schema, keyed_text, slices

LEAST_COVERAGE = 0.8
#: A copy may hold other words in between: its stretch is at most so many times as long.
STRETCH = 1.5
#: Places that a copy may begin at, by the matches that put it there, looked at each time.
SHIFTS = 3
MOST_TEMPLATE_WORDS = 1_000_000

#: The standard set: notices, file headers and texts of public licences, and the words of
#: the short ones that tell one licence from another (fixed values).
_STANDARD = json.loads(pkgutil.get_data(__package__, "licenses.json"))
TEMPLATES = {x["license"]: x["text"] for x in _STANDARD}
TELLING = {x["license"]: x["telling"] for x in _STANDARD}

_WORDS = re.compile(r"\w+").findall


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = value, i
        before[i] = top_at[pile - 1] if pile else -1
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _once(words, low: int, high: int) -> dict:
    place: dict = {}
    for i in range(low, high):
        place[words[i]] = -1 if words[i] in place else i
    return place


def patience(text, template) -> list[tuple[int, int]]:
    """Matched places (text, template), increasing in both."""
    found: list[tuple[int, int]] = []
    # Each gap: the ranges of both, and whether a match bounds it below and above.
    gaps = [(0, len(text), 0, len(template), False, False)]
    while gaps:
        a, b, c, d, below, above = gaps.pop()
        while below and a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while above and a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = _once(text, a, b), _once(template, c, d)
        shared = sorted(
            (i, ours[w]) for w, i in theirs.items() if i >= 0 and ours.get(w, -1) >= 0
        )
        kept = [shared[i] for i in _increasing([x for _, x in shared])]
        if not kept:
            found += _longest_common(text[a:b], template[c:d], a, c)
            continue
        at, ct, low = a, c, below
        for i, x in kept:
            found.append((x, i))
            gaps.append((at, x, ct, i, low, True))
            at, ct, low = x + 1, i + 1, True
        gaps.append((at, b, ct, d, True, above))
    return sorted(found)


def _longest_common(ours, theirs, a: int, c: int) -> list[tuple[int, int]]:
    """The places (from a and c on) of a longest common subsequence of a gap that has no
    anchor: a bit for each word of ours, a row for each of theirs, read backwards."""
    mask: dict = {}
    for x, w in enumerate(ours):
        mask[w] = mask.get(w, 0) | 1 << x
    full = row = (1 << len(ours)) - 1
    rows = []
    for w in theirs:
        hit = row & mask.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    pairs, x, i = [], len(ours), len(theirs)
    while x and i:
        if rows[i - 1] >> (x - 1) & 1:
            x -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (x - 1) & 1:
            x -= 1
            pairs.append((a + x, c + i))
    return pairs


class _Templates:
    def __init__(self, texts: dict[str, str], telling: dict[str, list[str]], least: float):
        self.names = sorted(texts)
        words = [_WORDS(texts[n].lower()) for n in self.names]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for t in words for w in t}))}
        self.words = [[self.ids[w] for w in t] for t in words]
        self.needs = [np.bincount(t, minlength=len(self.ids) + 1) for t in self.words]
        self.least = [max(1, int(np.ceil(least * len(t)))) for t in self.words]
        #: Places of the template that a copy has to match.
        self.telling = [
            {i for i, w in enumerate(t) if w in telling.get(n, ())}
            for n, t in zip(self.names, words, strict=True)
        ]
        # The words of all templates one after another, each with its count.
        self.full = [i for i, t in enumerate(self.words) if t]
        each = [np.flatnonzero(self.needs[i]) for i in self.full]
        none = np.zeros(0, np.int64)
        self.flat = np.concatenate([none, *each])
        self.times = np.concatenate([none, *(self.needs[i][w] for i, w in zip(self.full, each, strict=True))])
        size = np.array([len(w) for w in each], np.int64)
        self.begin = np.cumsum(size) - size
        self.masks: dict[int, dict[int, int]] = {}

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        if not self.full:
            return []
        get = self.ids.get
        ids = np.array([get(w, 0) for w in _WORDS((text or "").lower())], np.int64)
        have = np.bincount(ids, minlength=len(self.ids) + 1)
        shared = np.add.reduceat(np.minimum(have[self.flat], self.times), self.begin)
        copies = []
        for i, n in zip(self.full, shared.tolist(), strict=True):
            words = self.words[i]
            if n >= self.least[i] and all(have[words[j]] for j in self.telling[i]):
                for matched, first, last in self._copies(ids, i):
                    copies.append((2 * matched - len(words), matched, first, last, i))
        kept: dict[int, list] = {}
        for matched, first, last, i in _strongest(copies):
            kept.setdefault(i, []).append((-matched, first, last))
        out = []
        for i, mine in sorted(kept.items()):
            matched, first, last = min(mine)
            out.append((self.names[i], -matched / len(self.words[i]), first, last, len(mine)))
        return out

    def _copies(self, ids, number):
        """The copies of a template: matched words, first and last word."""
        words, need, least = self.words[number], self.needs[number], self.least[number]
        places = np.flatnonzero(need[ids] > 0)
        marks = ids[places].tolist()
        places = places.tolist()
        span = max(int(STRETCH * len(words)), len(words) + 2)
        count: dict[int, int] = {}
        good = left = 0
        copies, free, tried = [], 0, 0
        for right, mark in enumerate(marks):
            count[mark] = count.get(mark, 0) + 1
            good += count[mark] <= need[mark]
            while left < right and (places[right] - places[left] >= span or places[left] < free):
                out = marks[left]
                good -= count[out] <= need[out]
                count[out] -= 1
                left += 1
            if good < least or places[left] < free or places[left] < tried:
                continue
            # The stretch has just become rich enough; it ends within one more length.
            low = places[left]
            found = self._best(ids, low, len(ids), number, span)
            if not found:
                # A stretch that begins k words later has at most k more words in common.
                common = self._common(ids[low : low + span].tolist(), number)
                tried = low + max(1, least - common)
                continue
            free = found[2] + 1
            while found:
                copies.append(found)
                # A poorer copy may lie before the best one.
                found = self._best(ids, low, found[1], number, span)
        return copies

    def _common(self, part, number):
        """Length of the longest common subsequence, with a bit for each template word."""
        if number not in self.masks:
            mask = self.masks[number] = {}
            for j, w in enumerate(self.words[number]):
                mask[w] = mask.get(w, 0) | 1 << j
        mask, size = self.masks[number], len(self.words[number])
        full = row = (1 << size) - 1
        for w in part:
            hit = row & mask.get(w, 0)
            if hit:
                row = ((row + hit) | (row - hit)) & full
        return size - row.bit_count()

    def _best(self, ids, low, high, number, span):
        """The best copy (matches, first, last word) that begins near low and ends before high.

        The alignment of a stretch tells where a copy begins: at its first match, or where
        most matches put the template's first word. Stretches from there on are aligned
        too, until none is better. A match counts three times, and a word of the template
        that is left over within the copy counts against it, so that the end of another
        copy does not serve for this one's.
        """
        words, need, telling = self.words[number], self.needs[number], self.telling[number]
        least = self.least[number]
        best, most, starts, tried = None, (), [low], set()
        while starts:
            at = starts.pop()
            if at in tried or not low <= at < high:
                continue
            tried.add(at)
            for size in (len(words), span):
                part = ids[at : min(at + size, high)]
                pairs = patience(part.tolist(), words)
                if not pairs:
                    continue
                first, last = pairs[0][0], pairs[-1][0]
                over = int((need[part[first : last + 1]] > 0).sum()) - len(pairs)
                enough = len(pairs) >= least and telling <= {j for _, j in pairs}
                value = (enough, 3 * len(pairs) - over, first - last)
                if best is None or value > most:
                    shifts = Counter(i - j for i, j in pairs).most_common(SHIFTS)
                    starts += [*(at + shift for shift, _ in shifts), at + first]
                    best, most = (len(pairs), at + first, at + last), value
        return best if best is not None and most[0] else None


def _strongest(copies: list[tuple]) -> list[tuple]:
    """Without the copies that overlap one with more matched less missing words."""
    firsts: list[int] = []
    taken: list[tuple[int, int]] = []
    out = []
    for _, group in groupby(sorted(copies, key=lambda c: -c[0]), key=lambda c: c[0]):
        free = []
        for _, *copy in group:
            # Stretches that are taken do not overlap once merged, so one look-up tells.
            at = bisect_right(firsts, copy[2])
            if not at or taken[at - 1][1] < copy[1]:
                free.append(copy)
        out += free
        merged: list[tuple[int, int]] = []
        for first, last in sorted(taken + [(c[1], c[2]) for c in free]):
            if merged and first <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
            else:
                merged.append((first, last))
        taken, firsts = merged, [first for first, _ in merged]
    return out


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id",
    text: str = "text", least_coverage: float = LEAST_COVERAGE,
    telling: dict[str, list[str]] = TELLING,
) -> DataFrame:
    """Key, license, coverage, first and last word, copies: a row for each template found.

    Words are runs of letters, digits and underscores in lower case. coverage is the best
    copy's share of the template's words, at least least_coverage; among equal copies the
    first counts. A copy matches all telling words of its template, where some are named
    for it. Of overlapping copies of several templates the one with most matched less
    missing words counts, or all such. A null or empty text, and a template without words, match nothing;
    repeated rows are scanned each; an empty table gives no rows; null keys stay; other
    columns are not read. Whole texts are scanned.
    """
    if sum(len(t.split()) for t in templates.values()) > MOST_TEMPLATE_WORDS:
        raise ValueError("more template words than a broadcast should hold")
    held = _Templates(templates, telling, least_coverage)
    shared = docs.sparkSession.sparkContext.broadcast(held)
    rest = "license string, coverage double, first long, last long, copies long"
    schema = keyed_schema(docs, key, rest)
    out = arrow_schema(schema)

    def task(batches):
        scan = shared.value.scan
        for part in slices(batches):
            found = [
                (k, *row)
                for k, t in zip(part["key"].to_pylist(), part["text"].to_pylist(), strict=True)
                for row in scan(t)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], f.type) for i, f in enumerate(out)], schema=out
            )

    rows = keyed_text(docs, key, text).mapInArrow(task, schema)
    return rows.select(F.col("key").alias(key), *rows.columns[1:])

"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified (a suffix is "small" if it precedes the one after it). The
substrings from one leftmost small place to the next are sorted by inducing, named, and
sorted among each other recursively; the order of all suffixes is then induced linearly.
Over few symbols a whole bucket is induced at once with array operations; over many
symbols, in the recursion, place by place.
"""

from __future__ import annotations

import numpy as np

#: Symbols up to which buckets are large enough to be induced as arrays.
FEW_SYMBOLS = 1024


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order; text holds small non-negative integers."""
    # The end is a symbol of its own, below all others.
    whole = np.append(text.astype(np.int64) + 1, 0)
    return _sorted(whole, int(whole.max()) + 1)[1:]


def _small(text: np.ndarray) -> np.ndarray:
    """Whether each suffix precedes the one after it; the end is small."""
    n = len(text)
    small = np.zeros(n, bool)
    small[-1] = True
    if n == 1:
        return small
    step = np.sign(text[1:] - text[:-1])
    # Within a run of one symbol, what follows the run decides.
    place = np.where(step != 0, np.arange(n - 1), n)
    decides = np.minimum.accumulate(place[::-1])[::-1]
    small[:-1] = step[np.minimum(decides, n - 2)] > 0
    return small


def _sorted(text: np.ndarray, symbols: int) -> np.ndarray:
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _small(text)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(text, minlength=symbols)
    induce = _induced_by_bucket if symbols <= FEW_SYMBOLS else _induced_by_place
    if len(left) < 2:
        return induce(text, small, left, sizes)
    first = induce(text, small, left, sizes)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    ordered = first[is_left[first]]
    names, count = _names(text, left, ordered)
    if count < len(left):
        order = left[_sorted(names, count)]
    else:
        order = np.empty(len(left), np.int64)
        order[names] = left
    return induce(text, small, order, sizes)


def _names(text: np.ndarray, left: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """A rank for each leftmost-small substring, equal for equal ones, in text order."""
    n, m = len(text), len(left)
    number = np.full(n, -1, np.int64)
    number[left] = np.arange(m)
    at = number[ordered]
    # A substring goes on to the next leftmost small place, which it includes.
    length = np.append(np.diff(left), 0)[at] + 1
    same = np.zeros(m, bool)
    pair = np.flatnonzero(length[1:] == length[:-1]) + 1
    off = 0
    while len(pair):
        equal = text[ordered[pair] + off] == text[ordered[pair - 1] + off]
        pair = pair[equal]
        off += 1
        done = length[pair] <= off
        same[pair[done]] = True
        pair = pair[~done]
    rank = np.cumsum(~same) - 1
    names = np.empty(m, np.int64)
    names[at] = rank
    return names, int(rank[-1]) + 1


def _deal(target: np.ndarray, edge: np.ndarray, symbol: np.ndarray, place: np.ndarray, way: int):
    """Appends places to their symbols' buckets in the given order, upwards or downwards."""
    order = np.argsort(symbol, kind="stable")
    symbol, place = symbol[order], place[order]
    cut = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    count = np.diff(np.append(cut, len(symbol)))
    within = np.arange(len(symbol)) - np.repeat(cut, count)
    target[edge[symbol] + way * within] = place
    edge[symbol[cut]] += way * count


def _induced_by_bucket(text, small, order, sizes) -> np.ndarray:
    """All suffixes in order, from the leftmost small ones in order; a bucket at a time."""
    n = len(text)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    symbol = (text.astype(np.int16) if len(sizes) <= FEW_SYMBOLS else text)
    mark = symbol[order]
    by = order[np.argsort(mark, kind="stable")]
    given = np.searchsorted(symbol[by], np.arange(len(sizes) + 1))
    head = starts.copy()
    used = np.flatnonzero(sizes)
    for c in used:
        low = starts[c]
        done = low
        while done < head[c]:  # each turn takes what the turn before put into this bucket
            now = out[done : head[c]]
            done = head[c]
            before = now[now > 0] - 1
            before = before[~small[before] & (symbol[before] == c)]
            out[head[c] : head[c] + len(before)] = before
            head[c] += len(before)
        now = np.concatenate([out[low : head[c]], by[given[c] : given[c + 1]]])
        before = now[now > 0] - 1
        before = before[~small[before] & (symbol[before] != c)]
        if len(before):
            _deal(out, head, symbol[before], before, 1)
    tail = ends - 1
    for c in used[::-1]:
        high = ends[c] - 1
        done = high
        while done > tail[c]:
            now = out[tail[c] + 1 : done + 1][::-1]
            done = tail[c]
            before = now[now > 0] - 1
            before = before[small[before] & (symbol[before] == c)]
            out[tail[c] + 1 - len(before) : tail[c] + 1] = before[::-1]
            tail[c] -= len(before)
        now = np.concatenate(
            [out[tail[c] + 1 : high + 1][::-1], out[starts[c] : head[c]][::-1]]
        )
        before = now[now > 0] - 1
        before = before[small[before] & (symbol[before] != c)]
        if len(before):
            _deal(out, tail, symbol[before], before, -1)
    # The end itself precedes all and is induced by nothing.
    out[0] = n - 1
    return out.astype(np.int64)


def _induced_by_place(text, small, order, sizes) -> np.ndarray:
    """The same, one place after the other."""
    ends = np.cumsum(sizes)
    # The symbol before each place if that one is large, or small; -1 if not, or unset.
    large_before = [-1, *np.where(small, -1, text)[:-1].tolist(), -1]
    small_before = [-1, *np.where(small, text, -1)[:-1].tolist(), -1]
    out = np.full(len(text), -1, np.int64)
    symbol = text[order]
    by = np.argsort(symbol, kind="stable")
    count = np.bincount(symbol, minlength=len(sizes))
    within = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    out[(ends - count)[symbol[by]] + within] = order[by]
    out = out.tolist()
    head = (ends - sizes).tolist()
    for i in out:
        c = large_before[i]
        if c >= 0:
            at = head[c]
            out[at] = i - 1
            head[c] = at + 1
    tail = ends.tolist()
    for i in reversed(out):
        c = small_before[i]
        if c >= 0:
            at = tail[c] - 1
            out[at] = i - 1
            tail[c] = at
    return np.array(out, np.int64)


def common_prefixes(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Length of the prefix that each suffix, by place, shares with the one before it in order.

    A place whose symbol before equals that of its neighbour has one less than the place
    before it; only the others are compared, eight symbols at a time.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    neighbour = np.full(n, -1, np.int64)
    neighbour[suffixes[1:]] = suffixes[:-1]
    both = (neighbour > 0) & (np.arange(n) > 0)
    same = np.zeros(n, bool)
    same[both] = text[np.flatnonzero(both) - 1] == text[neighbour[both] - 1]
    # The place before must have the neighbour before too, which makes its length known.
    chained = np.zeros(n, bool)
    chained[1:] = same[1:] & (neighbour[1:] - 1 >= 0)
    start = np.flatnonzero(~chained)
    padded = np.concatenate([text.astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    length = np.zeros(n, np.int64)
    a = start[neighbour[start] >= 0]
    b = neighbour[a]
    at = np.zeros(len(a), np.int64)
    who = np.arange(len(a))
    while len(who):
        x, y = a[who] + at[who], b[who] + at[who]
        left = n - np.maximum(x, y)
        differs = words[np.minimum(x, n)] != words[np.minimum(y, n)]
        same_bytes = np.where(differs.any(axis=1), differs.argmax(axis=1), 8)
        same_bytes = np.minimum(same_bytes, np.maximum(left, 0))
        at[who] += same_bytes
        who = who[same_bytes == 8]
    length[a] = at
    last = np.maximum.accumulate(np.where(chained, 0, np.arange(n)))
    return np.maximum(length[last] - (np.arange(n) - last), 0)

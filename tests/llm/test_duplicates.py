"""Near duplicates and repeated strings against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from ratelake.llm import suffix_array as sa
from ratelake.llm.components import components
from ratelake.llm.repeats import remove_repeats
from ratelake.llm.simhash import GrayIndex, fingerprint, gray_rank, near_duplicates

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(codes, distance=4):
    """Brute force: the least index of each code's component."""
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (int(codes[i]) ^ int(codes[j])).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(codes))]


def test_gray_rank_inverts_the_code():
    n = np.arange(5000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("flips", [1, 3, 6, 40])
def test_index_finds_all_components(flips):
    rng = np.random.default_rng(flips)
    seeds = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    codes = set(seeds.tolist())
    while len(codes) < 700:
        code = int(rng.choice(seeds))
        for bit in rng.integers(0, 64, flips):
            code ^= 1 << int(bit)
        codes.add(code)
    codes = np.array(sorted(codes), np.uint64)
    index = GrayIndex(np.zeros(len(codes), np.int64), codes, 4)
    got = index.forest()
    want = roots(index.code)
    assert got.tolist() == want


def edge_rows():
    base = prose(300)
    words = base.split(" ")
    rows = [(None, base + " null key"), (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one")]
    rows += [(6, base), (7, base.upper().replace("É", "é")), (6, base), (6, prose(50))]
    for i in range(40):
        edited = list(words)
        edited[RNG.randrange(len(words))] = "edit"
        rows.append((100 + i, " ".join(edited)))
    rows += [(200 + i, prose(RNG.randint(1, 60))) for i in range(100)]
    rows.append((400, prose(20000)))
    return rows


@pytest.mark.parametrize("group_nodes", [20_000, 70])
def test_near_duplicates_equal_brute_force(spark, group_nodes):
    rows = edge_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, tie int")
    got = near_duplicates(frame, group_nodes=group_nodes).collect()
    codes = sorted({plain_fingerprint(t) for _, t in rows})
    root = dict(zip(codes, roots(codes), strict=True))
    least = {}
    for k, t in rows:
        group = root[plain_fingerprint(t)]
        if k is not None:
            least[group] = min(k, least.get(group, k))
    want = Counter((k, f"{(c := plain_fingerprint(t)):016x}", least.get(root[c])) for k, t in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    chosen = {(r.component_id, r.doc_id, r.tie) for r in got if r.chosen}
    assert len(chosen) == len(set(root.values()))
    assert near_duplicates(frame.limit(0)).count() == 0


def test_fingerprint_in_parts(monkeypatch):
    text = prose(3000)
    whole = fingerprint(text)
    monkeypatch.setattr("ratelake.llm.simhash.HASHES", 100)
    assert fingerprint(text) == whole == plain_fingerprint(text)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(200)] + [(7, 7), (500, 400)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components(frame).collect()}
    assert all(got[i] == 0 for i in range(51))
    assert all(got[100 + i] == 100 for i in range(200)) and got[500] == got[400] == 400
    assert components(frame.limit(0)).count() == 0


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("few", [0, 3, 1024])
def test_suffix_arrays_equal_sorting(few, monkeypatch):
    monkeypatch.setattr(sa, "FEW_SYMBOLS", few)
    rng = random.Random(few)
    for _ in range(400):
        text = [rng.randrange(rng.choice([1, 2, 4, 250])) for _ in range(rng.randint(1, 50))]
        text = (text * 3)[: rng.randint(1, 90)]
        order = sa.suffix_array(np.array(text, np.uint8))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        got = sa.common_prefixes(np.array(text, np.uint8), order)
        for before, at in zip([None, *want], want, strict=False):
            assert got[at] == (0 if before is None else shared(text[at:], text[before:]))


def plain_removal(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((sum(gone), spans, kept))
    return out


@pytest.mark.parametrize("shard_runs", [5000, 1])
def test_repeats_equal_brute_force(spark, shard_runs):
    passage, line = prose(120), prose(60)
    texts = [None, "", "short", "a" * 1000, "ab" * 400, prose(2000)]
    for i in range(30):
        texts.append(prose(RNG.randint(0, 80)) + passage[i : 300 + 9 * i] + prose(40) + line)
    texts += [texts[7], texts[7], texts[8][:-1], texts[-3] + "é" * 300, prose(30)[:199]]
    rows = [(i, t, i, "x") for i, t in enumerate(texts)] + [(None, texts[9], 0, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, spans string")
    got = remove_repeats(frame, shard_runs=shard_runs).collect()
    data = [(r[1] or "").encode() for r in rows]
    want = plain_removal(data, 200)
    found = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for row, text, (gone, spans, kept) in zip(rows, data, want, strict=True):
        r = found[row[0]]
        assert (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) == (len(text), gone, spans, kept)
    assert remove_repeats(frame.limit(0)).count() == 0


def test_long_texts_are_hashed_in_blocks(spark, monkeypatch):
    import ratelake.llm.repeats as repeats

    text = prose(900).encode()
    whole = list(repeats.runs([text]))
    monkeypatch.setattr(repeats, "BLOCK", 500)
    parts = list(repeats.runs([text]))
    assert len(parts) > 3

    def starts(found):
        return [h for x in found for h, n in zip(x[1].tolist(), x[3].tolist(), strict=True) for _ in range(n)]

    assert starts(whole) == starts(parts)

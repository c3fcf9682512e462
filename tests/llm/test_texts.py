"""Language, quality, test items, licences, URL lists and the pipeline."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratelake.llm import quality_rules
from ratelake.llm.decontamination import GAP, MATCH, MISMATCH, _count_words, align, contaminated, words_of
from ratelake.llm.language_id import (
    BUCKETS, SCRIPTS, _Labeller, LanguageModel, hashed, in_holdout, language_spans, learn,
)
from ratelake.llm.license_scan import TELLING, TEMPLATES, _longest_common, _Templates, patience, scan_licenses
from ratelake.llm.quality_rules import log_tail, quality_verdicts
from ratelake.llm.queries import registered
from ratelake.llm.url_filter import filter_captures

SF = "/root/testdata/sf0.001"


# --- language


def viterbi(rows, switch):
    """Brute force over one text: scores of the best labelling."""
    best = rows[0].astype(float)
    for row in rows[1:]:
        best = row + np.maximum(best, best.max() - switch)
    return best.max()


def value(rows, label, switch):
    total = rows[np.arange(len(rows)), label].astype(float).sum()
    return total - switch * np.count_nonzero(np.diff(label))


def test_labelling_is_the_best_one():
    rng = np.random.default_rng(1)
    model = LanguageModel(list("abc"), np.zeros((3, 4), np.float32), np.ones((3, 1), bool))
    labeller = _Labeller(model, 2.0)
    labeller.rows = -rng.random((50, 3)).astype(np.float32) * 3
    texts = [rng.integers(0, 50, n) for n in (1, 2, 7, 40, 200, 0)] * 5
    for words, label in zip(texts, labeller.labels(texts), strict=True):
        if len(words):
            rows = labeller.rows[words]
            assert math.isclose(value(rows, label, 2.0), viterbi(rows, 2.0), abs_tol=1e-4)


def test_labelling_that_leaves_the_best_sum_everywhere():
    model = LanguageModel(list("abc"), np.zeros((3, 4), np.float32), np.ones((3, 1), bool))
    labeller = _Labeller(model, 8.0)
    rng = np.random.default_rng(6)
    labeller.rows = np.array([[-7, 0, -50], [-7, -50, 0]] + [[0, 0, 0]] * 60, np.float32)
    labeller.rows[2:] = -rng.integers(0, 12, (60, 3))
    texts = [np.array([0, 1]), *(rng.integers(0, 62, n) for n in (2, 3, 4, 6) for _ in range(300))]
    labels = labeller.labels(texts)
    assert labels[0].tolist() == [1, 2]
    for words, label in zip(texts, labels, strict=True):
        rows = labeller.rows[words]
        assert math.isclose(value(rows, label, 8.0), viterbi(rows, 8.0), abs_tol=1e-4)


def test_language_of_any_row(spark):
    labelled = [(i, t, lang, "x") for i, (t, lang) in enumerate(
        [("the house and the garden of the king", "en"), ("das Haus und der Garten des Königs", "de"),
         ("дом и сад короля", "ru"), (None, "en"), ("no label", None)] * 5)]
    frame = spark.createDataFrame(labelled, "doc_id long, text string, lang string, score string")
    model = learn(frame)
    assert model.languages == ["de", "en", "ru"]
    asked = [(1, "the garden"), (2, None), (3, " 12 .. "), (None, "der Garten"), (4, "король"), (4, "король")]
    asked += [(5, "the house and the garden of the king " * 3 + "das Haus und der Garten des Königs " * 3)]
    asked += [(6, "the garden " * 20000)]
    rows = spark.createDataFrame(asked, "doc_id long, text string")
    got = language_spans(rows, model).collect()
    found = {r.doc_id: r for r in got}
    assert len(got) == len(asked)
    assert [found[k].lang_pred for k in (1, 2, 3, None, 4, 6)] == ["en", "und", "und", "de", "ru", "en"]
    assert found[2].score == 0 and 0 <= found[5].score <= 1
    assert [s.lang for s in found[5].spans] == ["en", "de"]
    assert sum(s.words for s in found[5].spans) == len(asked[6][1].split())
    none = language_spans(rows, learn(frame.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def plain_grams(run):
    edged = f"^{run}$"
    cut = [edged[i : i + n] for n in (1, 2, 3) for i in range(len(edged) - n + 1)]
    return [zlib.crc32(gram.encode("utf-8", "replace")) % BUCKETS for gram in cut]


def test_buckets_equal_plain():
    rng = random.Random(3)
    runs = ["a", "дом", "漢字", "𝒜bc𝒜", "ﬁé", "x\ud800y"]
    runs += ["".join(rng.choices("abcéßжя字𝒜", k=rng.randint(1, 9))) for _ in range(300)]
    script, count, buckets = hashed(runs)
    expected = [plain_grams(run) for run in runs]
    assert buckets.tolist() == sum(expected, [])
    assert count.tolist() == list(map(len, expected))
    assert [SCRIPTS[i] for i in script[:4]] == ["Latin", "Cyrillic", "Han", "Other"]


def test_new_words_cost_no_hash_for_each_gram(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(3000)]
    calls, crc32 = [], zlib.crc32
    monkeypatch.setattr(zlib, "crc32", lambda *a: calls.append(1) or crc32(*a))
    scores = np.random.default_rng(5).random((2, BUCKETS)).astype(np.float32)
    labeller = _Labeller(LanguageModel(["a", "b"], scores, np.ones((2, len(SCRIPTS)), bool)), 8.0)
    (found,) = labeller.words([" ".join(words)])
    # The words have more than ten thousand different n-grams.
    assert len(calls) < 2000
    monkeypatch.undo()
    for word, row in zip(words[:50], labeller.rows[found[:50]], strict=True):
        plain = 0.4 * scores[:, plain_grams(word)].sum(axis=1)
        assert np.allclose(row, plain - plain.max(), atol=1e-3)


def test_scoring_is_bounded_for_many_languages():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=20)) for _ in range(4000)]
    n = 300
    model = LanguageModel(
        [f"{i:03}" for i in range(n)], np.zeros((n, BUCKETS), np.float32), np.ones((n, len(SCRIPTS)), bool)
    )
    labeller = _Labeller(model, 8.0)
    tracemalloc.start()
    labeller.words([" ".join(words)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All n-grams at once would take 4000 x 63 x 300 x 4 bytes.
    assert peak < 120e6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_spans(docs, learn(docs.where(~in_holdout("doc_id"))))
    held = found.join(docs, "doc_id").where(in_holdout("doc_id") & F.col("lang").isNotNull())
    right, n = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right > 0.95


# --- quality


def test_exact_binomial_tail(spark):
    frame = spark.createDataFrame([(0, 5), (3, 50), (49, 1000), (5, 5), (200, 100000)], "k long, n long")
    for r in frame.select("k", "n", log_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect():
        logs = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1)
                + i * math.log(0.05) + (r.n - i) * math.log(0.95) for i in range(r.k + 1)]
        top = max(logs)
        assert math.isclose(r.p, top + math.log(sum(math.exp(x - top) for x in logs)), abs_tol=1e-6)


def plain_counts(text):
    text = text or ""
    word = re.compile("[^\x20\x09-\x0d]+")
    words, lines = word.findall(text), [x for x in text.split("\n") if word.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    again = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(again)


def test_quality_counts_and_cutoffs(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["alpha", "béta", "gamma", "del\x0bta"]) + str(rng.random()) for _ in range(n))
    texts = [None, "", "one", "a b c d e f g h i " * 9, "x\ny\nx\n \n", words(9000)]
    texts += [words(30) for _ in range(3000)] + [words(30) + " ###" * 40 for _ in range(200)]
    rows = [(i, t, "en" if i % 2 else None, i) for i, t in enumerate(texts)] + [(None, words(25), "de", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept long")
    labels = [(i, int(i < 3006), "x") for i in range(6, len(texts))] + [(7, 1, "x"), (None, 1, "x"), (8, None, "x")]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in quality_verdicts(docs, frame).collect()}
    for key, text, _, _ in rows:
        r = got[key]
        counts = plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
    good = [got[i] for i in range(6, 3006)]
    assert all(r.kept for r in good)
    assert not any(got[i].kept for i in range(3006, 3206)), "symbols are told from words"
    # Too few labels prove nothing: then only the base rules count.
    few = quality_verdicts(docs, frame.limit(50)).where("kept = base_failed")
    assert few.count() == 0
    assert quality_verdicts(docs, frame.limit(0)).count() == len(rows)
    assert quality_verdicts(docs.limit(0), frame).count() == 0
    assert set(quality_rules.SIGNALS) == {"symbols", "dup_lines", "repeats", "capitals"}


# --- test items


def plain_align(item, words):
    score = [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(words) + 1):
            step = MATCH if item[i - 1] == words[j - 1] else MISMATCH
            score[i][j] = max(0, score[i - 1][j - 1] + step, score[i - 1][j] + GAP, score[i][j - 1] + GAP)
    return max(map(max, score))


def test_alignment_equals_plain():
    rng = np.random.default_rng(5)
    for _ in range(200):
        item, words = rng.integers(1, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(1, 25))
        assert align(item, words)[0] == plain_align(item.tolist(), words.tolist())


@pytest.mark.parametrize("block_words", [400_000, 40])
def test_copies_of_items_are_found(spark, block_words):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = {i: [word() for _ in range(30)] for i in range(6)}
    around = lambda n=40: [word() for _ in range(n)]
    edited = list(items[1])
    for at in (6, 13, 14, 22):
        edited[at] = word()
    shorter = items[2][:10] + items[2][12:]
    texts = {
        1: around() + items[0] + around(), 2: around() + edited + around(), 3: shorter + around(),
        4: around(20000) + items[3], 5: around(), 6: items[4][:6] + around(), 7: items[0] + items[3],
    }
    rows = [(k, " ".join(t).title() + ".", 1.0) for k, t in texts.items()]
    rows += [(8, None, 1.0), (9, "", 1.0), (None, " ".join(items[5]), 1.0), (1, rows[0][1], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    asked = [(i, ", ".join(t), "x") for i, t in items.items()]
    asked += [(10, None, "x"), (11, "too short", "x"), (None, " ".join(items[0]), "x")]
    bench = spark.createDataFrame(asked, "item_id long, text string, doc_id string")
    got = Counter((r.doc_id, r.item_id) for r in contaminated(docs, bench, block_words=block_words).collect())
    want = {(1, 0): 2, (1, None): 2, (2, 1): 1, (3, 2): 1, (4, 3): 1, (7, 0): 1, (7, None): 1, (7, 3): 1, (None, 5): 1}
    assert got == Counter(want)
    assert contaminated(docs.limit(0), bench).count() == contaminated(docs, bench.limit(0)).count() == 0


def test_copies_with_edits_all_along_are_found(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = {i: [word() for _ in range(36)] for i in range(8)}
    around = lambda: [word() for _ in range(20)]
    every = lambda i, n: [word() if at % n == n - 1 else w for at, w in enumerate(items[i])]
    apart = [w for x in items[4] for w in (x, word())]
    many = [w for i in range(1200) for w in [word()]] + every(5, 4) + around()
    texts = {0: every(0, 6), 1: every(1, 5), 2: every(2, 4), 3: every(3, 3), 4: apart, 5: many,
             6: every(6, 5), 7: items[6], 8: every(7, 2)}
    rows = [(k, " ".join(around() + t + around())) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(docs, bench).collect()}
    # Every n-th word replaced, a word put after every word, and beside an exact copy.
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6)}
    for (doc, item), score in got.items():
        ids = {w: i for i, w in enumerate(items[item])}
        words = [ids.get(w, -1) for w in rows[doc][1].split()]
        assert math.isclose(score, plain_align(list(range(36)), words) / 72)


def test_short_items_and_unspaced_scripts(spark):
    ten, eight, seven = ([f"{c}{i}" for i in range(n)] for c, n in (("t", 10), ("e", 8), ("s", 7)))
    two = ten[:3] + ["x"] + ten[4:7] + ["y"] + ten[8:]
    items = {0: " ".join(ten), 1: " ".join(eight), 2: " ".join(seven), 3: "我们今天去公园看红色的花", 4: "ฉันชอบกนขาว",
             5: "今日は公園で花を見た", 6: "три слова"}
    texts = {0: " ".join(two), 1: " ".join(ten[:7]), 2: " ".join([*eight[:4], "x", *eight[4:]]),
             3: " ".join([*seven[:3], "x", *seven[4:]]), 4: "昨天我们今天去公园看蓝色的花。", 5: "เขา" + items[4],
             6: "「" + items[5] + "」", 7: " ".join(seven), 8: items[6], 9: "公园 花"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(docs, bench).collect()}
    # Eight of ten words match in 0, seven in 1; 3 lacks a word of an item of seven.
    assert got == {(0, 0): 14 / 20, (2, 1): 15 / 16, (4, 3): 21 / 24, (5, 4): 1, (6, 5): 1, (7, 2): 1}


def test_blocks_count_the_words_of_any_script(spark):
    texts = ["дом и сад короля", "ο κήπος του βασιλιά", "the garden", "公园", None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert _count_words(frame) == sum(len(words_of(t)) for t in texts) == 12
    assert _count_words(frame.limit(0)) == 0


# --- licences


def test_patience_pairs_increase_and_match():
    rng = random.Random(2)
    for _ in range(300):
        text, template = ([rng.randrange(9) for _ in range(rng.randint(0, 20))] for _ in range(2))
        pairs = patience(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))
    assert patience("xxabcxx", "abc") == [(2, 0), (3, 1), (4, 2)]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("words", [8, 12, 40])
def test_exact_copies_are_never_lost(words):
    """Copies of templates over few words, surrounded by their own words."""
    rng = random.Random(words)
    names = [f"w{i}" for i in range(words)]
    scan = "w2 w7 w1 w10 w10 w4 w10 w5 w1 w5 w4 w7"
    assert _Templates({"t": "w1 w10 w10 w4 w10 w5 w1 w5 w4"}, {}, 0.8).scan(scan)[0][1] == 1.0
    for _ in range(1500):
        template = [rng.choice(names) for _ in range(rng.randint(4, 40))]
        before, after = ([rng.choice(names) for _ in range(rng.randint(0, 12))] for _ in range(2))
        (row,) = _Templates({"t": " ".join(template)}, {}, 0.8).scan(" ".join(before + template + after)) or [None]
        assert row is not None and row[1] == 1.0, (template, before, after)


def test_gaps_without_anchors_take_the_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(2000):
        a = [rng.choice("xyz") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("xyz") for _ in range(rng.randint(0, 14))]
        pairs = sorted(_longest_common(a, b, 5, 7))
        assert all(a[x - 5] == b[i - 7] for x, i in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == longest_common(a, b)


def test_licences_in_any_row(spark):
    mit, whole = TEMPLATES["MIT-notice"], TEMPLATES["MIT-permission"]
    edited = whole.replace("free of charge, ", "").replace("Software", "Program", 2)
    rows = [(1, f"Text. {mit}\n{mit} More."), (2, None), (3, ""), (None, mit.upper()), (4, edited),
            (5, "the License of the MIT is under discussion"), (6, "the " * 50000), (1, mit)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = [(r.doc_id, r.license, r.copies, r.coverage) for r in scan_licenses(docs).collect()]
    assert Counter(r[:3] for r in got) == Counter(
        [(1, "MIT-notice", 2), (1, "MIT-notice", 1), (None, "MIT-notice", 1), (4, "MIT-permission", 1)]
    )
    assert all(0.9 < r[3] <= 1 for r in got)
    assert scan_licenses(docs.limit(0)).count() == scan_licenses(docs, {"none": ""}).count() == 0


def test_exact_copies_are_whole_whatever_stands_before(spark):
    short = [n for n, t in TEMPLATES.items() if len(t.split()) < 300]
    rows = []
    for name in short:
        words = re.findall(r"\w+", TEMPLATES[name])
        for lead in ("the", "the of this", f"{words[1]} x {words[-1]}", " ".join(words[: len(words) // 2])):
            text = f"{lead} {TEMPLATES[name]} and"
            rows.append((len(rows), text, name, len(re.findall(r"\w+", lead)), len(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string, lead long, size long")
    got = {(r.doc_id, r.license): r for r in scan_licenses(docs).collect()}
    for doc, _, name, lead, size in rows:
        r = got[doc, name]
        assert (r.coverage, r.first, r.last, r.copies) == (1.0, lead, lead + size - 1, 1), (doc, name)
    # An edited copy before a whole one is a copy of its own, and takes nothing from it.
    notice = TEMPLATES["GPL-3.0-notice"]
    both = notice.replace("General Public ", "") + " " + notice
    (r,) = scan_licenses(spark.createDataFrame([(1, both)], "doc_id long, text string")).collect()
    assert (r.license, r.coverage, r.first, r.last, r.copies) == ("GPL-3.0-notice", 1.0, 10, 21, 2)


def test_planted_licences_are_told_apart(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for name, text in TEMPLATES.items():
        words = re.findall(r"\w+", text)
        rows.append((name, " ".join([word() for _ in range(9)] + words + [word()])))
        if len(words) > 100:
            edited = [word() if at % 17 == 8 and w.lower() not in TELLING[name] else w for at, w in enumerate(words)]
            rows.append((name, " ".join([word()] + edited)))
    others = ["Released under the Foo License.", "Licensed under CC BY 9.0.", "licensed under the GNU license",
              "This work is licensed under the Foo General Public License, version 3."]
    texts = [t for _, t in rows] + others
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in scan_licenses(docs).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.copies))
    for i, (name, _) in enumerate(rows):
        assert got.get(i) == [(name, 1)], (name, got.get(i))
    assert not set(got) - set(range(len(rows)))
    said = {"Released under the BSD License": "BSD-notice", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0-notice",
            "Licensed under CC BY 4.0": "CC-BY-4.0-notice"}
    docs = spark.createDataFrame([(k, v) for v, k in said.items()], "doc_id string, text string")
    assert {(r.doc_id, r.license) for r in scan_licenses(docs).collect()} == {(k, k) for k in said.values()}


# --- URL lists


def test_lists_as_they_stood(spark):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [("a.com", True, day(5)), ("a.com", False, day(20)), ("x.a.com", False, day(10)),
               ("b.org/bad", True, day(1)), ("a.com", False, day(5)), (None, True, day(1)), ("c.de", None, day(1)),
               ("c.de", True, None)]
    listed = spark.createDataFrame(entries, "key string, listed boolean, since string").withColumn("since", F.col("since").cast("timestamp"))
    asked = [("http://a.com/1", 4), ("http://a.com/1", 5), ("https://www.A.com:80/1#f", 19), ("http://a.com/1", 20),
             ("http://x.a.com", 9), ("http://x.a.com", 10), ("http://b.org/bad", 2), ("http://b.org/good", 2),
             (None, 3), ("no address", 3), ("http://c.de/", 9), ("http://a.com/1", None), ("http://a.com/1", 5)]
    rows = [(i, u, None if d is None else day(d), "x") for i, (u, d) in enumerate(asked)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at string, entry string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = {r.page_id: (r.blocked, r.entry) for r in filter_captures(captures, listed).collect()}
    assert [got[i] for i in range(13)] == [
        (False, None), (True, "a.com"), (True, "a.com"), (False, "a.com"), (True, "a.com"), (False, "x.a.com"),
        (True, "b.org/bad"), (False, None), (False, None), (False, None), (False, "c.de"), (False, None), (True, "a.com"),
    ]
    assert filter_captures(captures.limit(0), listed).count() == 0
    assert {r.blocked for r in filter_captures(captures, listed.limit(0)).collect()} == {False}


# --- the pipeline


def test_pipeline_stages_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
            assert out.count() <= kept.count()
        kept = corpus_pipeline.staged_rows(out, name)
    texts = {r.doc_id: r.n_tokens for r in kept.collect()}
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    assert texts == whole and 0 < len(texts) < docs.count()


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "the garden of the king", "en", "s", 1),
            (3, "the house", None, None, None), (3, "the house", None, None, None), (4, "x" * 300, "en", "s", 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        kept = frame
        for name, stage in corpus_pipeline.STAGES:
            kept = corpus_pipeline.staged_rows(stage(spark, kept, SF), name)
        # 300 equal letters repeat themselves; without them and the empty ones two are left.
        assert kept.count() == (2 if frame is docs else 0)


def test_stages_on_clashing_names_and_maps(spark):
    """Columns named as the stages' own, a map, and equal rows with other columns apart."""
    words = "the garden of the king and the house by the river"
    docs = spark.sql(f"""
        select cast(id as bigint) as doc_id, text, 'en' as lang, source,
          map('k', source) as extra, 'a' as __mark, 'b' as __tie, 'c' as mark, 'd' as row
        from values (1, '{words} one', 'z'), (1, '{words} one', 'a'), (2, 'another text \ufffd of it', 's'),
          (3, '{"é" * 150} ends', 's'), (4, 'é{"é" * 150} ends otherwise', 's') as t(id, text, source)""")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.staged_rows(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns, name
    rows = {r.doc_id: r for r in kept.collect()}
    # Of rows with equal id and text the one whose other columns come first stays.
    assert kept.where("doc_id = 1").count() == 1 and rows[1].source == "a"
    assert rows[1].extra == {"k": "a"} and rows[1]["__mark"] == "a"
    assert rows[2].text == "another text \ufffd of it"


def test_a_text_in_three_languages_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = {
        lang: docs.where(f"lang = '{lang}' and length(text) > 3000").orderBy("doc_id").first().text
        for lang in ("en", "fr", "de")
    }
    mixed = " ".join(text[:1000] for text in parts.values())
    row = docs.limit(1).selectExpr("-5L as doc_id", f"'{mixed}' as text", "lang", "source", "n_chars")
    out = corpus_pipeline.identify_language(spark, docs.unionByName(row), SF)
    assert out.where("doc_id = -5").count() == 1


def test_numbers_are_no_letters(spark):
    model = learn(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = ["½ ²", "①②", "Ⅷ", "12", "½ a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language_spans(docs, model).collect()}
    assert [found[i] == "und" for i in range(5)] == [True, True, True, True, False]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registered()) == list(range(1, 14))

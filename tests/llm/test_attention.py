"""Attention over passages: gradients, scores against the plain formula, held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratelake.llm import attention_quality as aq
from ratelake.llm.queries import op11_attention_quality
from tests.llm.test_text_codecs import ROWS, SCHEMA

SF_DIR = "/root/testdata/sf0.01"


def bags(seed=0, count=30):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 255, (rng.integers(1, 6), aq.FEATURES)).astype(np.uint8) for _ in range(count)]


def loss(model, found, labels):
    total = 0
    for bag, y in zip(found, labels):
        h, e, _ = model.passages(bag.astype(float))
        p = model.scores((e[:, None] * h).sum(axis=0)[None] / e.sum())[0]
        total -= y * np.log(p) + (1 - y) * np.log(1 - p)
    return total / len(found)


def test_gradients_are_those_of_the_loss():
    found, model = bags(), aq.untrained()
    model.mean, model.scale = np.full(aq.FEATURES, 127.0), np.full(aq.FEATURES, 1 / 70)
    rng = np.random.default_rng(1)
    model.weights["c"] = rng.normal(size=model.weights["c"].shape)
    labels = rng.integers(0, 2, len(found)).astype(float)
    sizes = np.array([len(x) for x in found])
    x = np.concatenate(found).astype(float)
    gradients = model.gradients(x, np.cumsum(sizes) - sizes, labels)
    for name, array in model.weights.items():
        for at in [tuple(rng.integers(0, n) for n in array.shape) for _ in range(6)]:
            before, step = array[at], 1e-5
            array[at] = before + step
            high = loss(model, found, labels)
            array[at] = before - step
            low = loss(model, found, labels)
            array[at] = before
            assert (high - low) / (2 * step) == pytest.approx(gradients[name][at], rel=1e-3, abs=1e-7)


def test_attention_finds_the_passage_that_decides():
    """A bag is bad if one of its passages is; the bad passage gets the largest weight."""
    rng = np.random.default_rng(3)
    found, labels, place = [], [], []
    for i in range(600):
        bag = rng.integers(0, 40, (int(rng.integers(2, 8)), aq.FEATURES)).astype(np.uint8)
        at = int(rng.integers(0, len(bag)))
        if i % 2:
            bag[at, :20] += 180
        found.append(bag)
        labels.append(float(i % 2 == 0))
        place.append(at)
    model = aq.fit(found[:500], np.array(labels[:500]))
    right = top = 0
    for bag, label, at in zip(found[500:], labels[500:], place[500:]):
        h, e, _ = model.passages(bag.astype(float))
        score = model.scores((e[:, None] * h).sum(axis=0)[None] / e.sum())[0]
        right += (score >= 0.5) == (label == 1)
        top += label == 0 and int(e.argmax()) == at
    assert right >= 97 and top >= 48


def test_features_do_not_depend_on_the_neighbours():
    texts = [b"", b"one two", ("Wörter und Wörter " * 90).encode(), b"x" * 3000, b"A!! B!! " * 200, b"\n \n"]
    together, sizes = aq.passage_features(texts)
    apart = [aq.passage_features([t]) for t in texts]
    assert np.array_equal(together, np.concatenate([x for x, _ in apart]))
    assert sizes.tolist() == [int(n[0]) for _, n in apart]
    assert sizes.tolist() == [1, 1, 4, 1, 4, 1]


def test_long_texts_in_blocks():
    """The running sums over blocks are the formula over all passages."""
    model = aq.fit(bags(), np.array([i % 2 for i in range(30)], float))
    long = "Some words, " * 60000
    data = long.encode()
    parts = [data[i : i + aq.BLOCK] for i in range(0, len(data), aq.BLOCK)]
    h, e, _ = model.passages(aq.passage_features(parts)[0].astype(float))
    want = model.scores((e[:, None] * h).sum(axis=0)[None] / e.sum())[0]
    found = aq._scored(model, ["short", long, None, "short", ""], 0.7)
    assert found["score"][1] == pytest.approx(want, abs=1e-12)
    assert found["n_passages"] == [1, len(e), 1, 1, 1]
    assert found["attended"][1] == int(e.argmax())
    assert found["attention"][1] == pytest.approx(e.max() / e.sum())
    assert found["score"][0] == found["score"][3] and found["score"][2] == found["score"][4]


def test_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame(
        [(1, 1, "x"), (2, 0, "x"), (3, 1, "x"), (3, 0, "x"), (None, 1, "x"), (4, None, "x"), (99, 1, "x")],
        "doc_id long, quality int, text string",
    )
    model = aq.learn(docs, labels)
    rows = aq.score_quality(docs, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    none = aq.learn(docs, labels.limit(0))
    assert {r.score for r in aq.score_quality(docs, none).collect()} == {0.5}
    empty = spark.createDataFrame([], SCHEMA)
    assert aq.score_quality(empty, aq.learn(empty, labels)).collect() == []


def test_query_on_held_out_labels(spark):
    rows = op11_attention_quality(spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "quality")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = rows.join(labels, "doc_id").withColumn("remainder", held).collect()
    assert all(r.held_out == r.remainder for r in found)
    test = [r for r in found if r.held_out]
    good = [r.score for r in test if r.quality == 1]
    bad = [r.score for r in test if r.quality == 0]
    above = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.95
    assert rows.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 300")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("doc_id < 300")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (aq.learn(docs, x, allowed=~held) for x in (labels, other))
    assert all(np.array_equal(one.weights[n], two.weights[n]) for n in one.weights)

"""The Merkle manifest against trees built level by level, on odd tables."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ratelake.llm import merkle_manifest
from ratelake.llm.merkle_manifest import Block, folded, joined, manifest, proofs, steps_of
from ratelake.llm.queries import LEAF, op13_merkle_manifest, tampered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, position long"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([joined(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def up(node, at, tree):
    """The node that a changed leaf makes of the root, and its siblings on the way."""
    proof = ""
    for level in tree[:-1]:
        other = at ^ 1
        if other >= len(level):
            node = joined(node)
        else:
            proof += level[other]
            node = joined(level[other], node) if at & 1 else joined(node, level[other])
        at >>= 1
    return node, proof


def digest(row, more=0):
    values = [row[c] + more if c == "n_chars" and row[c] is not None else row[c] for c in LEAF]
    return joined(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_force(rows):
    trees = {}
    for row in rows:
        spoiled = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0
        leaf = digest(row)
        order = (row.doc_id is not None, row.doc_id or 0, leaf)
        trees.setdefault(row.lang, []).append((order, leaf, digest(row, 1) if spoiled else leaf))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {name: levels([leaf for _, leaf, _ in sorted(trees[name])]) for name in names}
    top = levels([built[name][-1][0] for name in names])
    out = Counter()
    for nth, name in enumerate(names):
        for at, (order, leaf, now) in enumerate(sorted(trees[name])):
            node, proof = up(now, at, built[name])
            node, rest = up(node, nth, top)
            root = top[-1][0]
            end = sha256((proof + rest).encode()).hexdigest()
            key = order[1] if order[0] else None
            out[(key, leaf, built[name][-1][0], root, end, node, node == root)] += 1
    return out


def proved(docs, **options):
    found = proofs(manifest(docs, LEAF, changed=tampered, **options))
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return Counter(tuple(row) for row in found.select(*names).collect())


ODD = [
    (None, "a null key", "en", "s", 1, "x", 0),
    (None, "another", "en", None, None, "x", 0),
    (1, None, None, None, None, None, None),
    (2, "", "", "", 0, "x", 0),
    (8, "long " * 40000, "en", "s", 9223372036854775807, "x", 0),
    (3, "the same row", "zz", "s", 4, "x", 0),
    (3, "the same row", "zz", "s", 4, "x", 0),
    (3, "the same key", "zz", "s", 4, "x", 0),
    (4, "-", "-", "-", 4, "x", 0),
    (5, "日本語", "\U0001f600", "s", 4, "x", 0),
    (6, "another", "￿", "s", 4, "x", 0),
]


@pytest.mark.parametrize("levels_of_block", [2, 8])
def test_proofs_of_odd_rows(spark, levels_of_block):
    """Small blocks make several rounds; the result does not depend on the block."""
    rng = random.Random(levels_of_block)
    many = [
        (i, f"text {rng.random()}", rng.choice(["en", "en", "en", "de", None]), "s", i % 9, "x", 0)
        for i in range(10, 90)
    ]
    docs = spark.createDataFrame(ODD + many, SCHEMA).repartition(3)
    assert proved(docs, levels=levels_of_block) == brute_force(docs.collect())


@pytest.mark.parametrize("count", [0, 1, 2])
def test_few_rows(spark, count):
    docs = spark.createDataFrame(ODD[:count], SCHEMA)
    assert proved(docs) == (brute_force(docs.collect()) if count else Counter())


def test_equal_rows_are_spread(spark):
    """A third of the rows is one row; no partition of the range sort takes them all."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.lit("t").alias("text"),
        F.lit("en").alias("lang"),
        F.lit("s").alias("source"),
        F.lit(1).cast("long").alias("n_chars"),
    )
    assert proved(docs) == brute_force(docs.collect())
    leaves = docs.select(F.lit("=").alias("tree"), "doc_id", F.monotonically_increasing_id().alias("row"))
    placed = merkle_manifest._placed(leaves, ["tree", "doc_id", "row"])
    assert [r.position for r in placed.orderBy("position").collect()] == list(range(3000))
    assert placed.where("doc_id = 7").count() == 1001


def test_versions_share_nodes():
    """A version adds its leaf and one node a level; siblings are the first version's."""
    block = Block([joined(str(i)) for i in range(100)], 7)
    before = len(block.digest)
    root = block.version(37, joined("new"))
    assert len(block.digest) == before + 8
    shared = [c for node in range(before, len(block.digest)) for c in block.below[node] if c < before]
    assert len(shared) == 7
    assert block.digest[root] == folded(joined("new"), steps_of(block.path(37)))
    assert block.digest[block.root] == folded(joined("37"), steps_of(block.path(37)))


def test_whole_proofs(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = proofs(manifest(docs, LEAF), whole=True).collect()
    assert all(row.verified for row in rows)
    assert all(joined(row.proof) == row.proof_sha256 for row in rows)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    names = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert Counter(tuple(r) for r in found.select(*names).collect()) == brute_force(docs.collect())

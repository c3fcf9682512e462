"""The alignment of two tokenizers against the libraries and plain counting."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ratelake.llm.queries import op12_token_alignment
from ratelake.llm.token_alignment import Vocabularies, align, aligned_documents, pair_counts, summed
from tests.llm.test_text_codecs import BYTES, PIECES, ROWS, SCHEMA, random_texts

PATHS = (BYTES, PIECES)
NAMES = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


def byte_of_sign():
    """The byte that each sign of a byte-level vocabulary stands for."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(moved)}


SIGNS = byte_of_sign()


class Plain:
    """Whole texts through the libraries, tokens compared pair by pair."""

    def __init__(self):
        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def spans(self, pieces):
        out, at = [], 0
        for i, data in pieces:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    def tokens(self, text):
        if not text:
            return None
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(SIGNS[c] for c in self.a.id_to_token(i))) for i in a]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            data = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            b.append((i, data))
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return None
        return self.spans(a), self.spans(b)

    def links(self, text):
        found = self.tokens(text)
        if found is None:
            return []
        return [(i, j) for i, s, e in found[0] for j, t, f in found[1] if max(s, t) < min(e, f)]

    def row(self, text, counts, highest):
        found = self.tokens(text)
        if found is None:
            return (0, 0, 0, 0, 0, 0, "")
        a, b = found
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            sides = (",".join(str(i) for i, s, e in x if low <= s and e <= high) for x in (a, b))
            groups.append("|".join(sides))
        links = self.links(text)
        best = sum(counts[p] == highest[p[1]] for p in links)
        end = sha256(";".join(groups).encode()).hexdigest()
        return (len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), end)


def brute_force(rows):
    plain = Plain()
    counts = Counter(p for _, text in rows for p in plain.links(text))
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(n, highest.get(j, 0))
    return Counter((key, *plain.row(text, counts, highest)) for key, text in rows)


def short(rows):
    """Long texts are left to one test: the plain way compares all tokens with all."""
    return [row for row in rows if len(row[1] or "") < 5000]


def test_words_are_what_whole_texts_are():
    v, plain = Vocabularies(*PATHS), Plain()
    assert v.words_apart
    for text in random_texts(3000, seed=5):
        if not text:
            continue
        words = v.words(text)
        aligned = align(v, words)
        found = plain.tokens(text)
        if aligned.good.all():
            links = [(int(p) >> v.shift, int(p) & v.mask) for p in aligned.pairs]
            assert links == plain.links(text), text
            assert aligned.links.sum() == len(links)
            assert aligned.tokens_a.sum() == len(found[0]) and aligned.tokens_b.sum() == len(found[1])
        else:
            # Judged as a whole.
            assert bool(align(v, [text]).good[0]) == (found is not None), text


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_rows(spark, broadcast_bytes):
    texts = [(i, text, 0, "x") for i, text in enumerate(random_texts(300, seed=8), 10)]
    docs = spark.createDataFrame(short(ROWS) + texts, SCHEMA).repartition(5)
    found = aligned_documents(docs, PATHS, broadcast_bytes=broadcast_bytes, tasks_of_leaf=1)
    got = Counter(tuple(row) for row in found.select(*NAMES).collect())
    assert got == brute_force([(row.doc_id, row.text) for row in docs.collect()])


def test_long_texts(spark):
    """A text of 210,000 letters, and one word of 120,000; counts from the links alone."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = {row.doc_id: row for row in aligned_documents(docs, PATHS, whole=True).collect()}
    v = Vocabularies(*PATHS)
    for key in (4, 5):
        text = next(row[1] for row in ROWS if row[0] == key)
        assert rows[key].n_a == len(v.a.encode(" " + text).ids)
        assert rows[key].n_b == len(v.b.encode(text))
        assert rows[key].n_links == rows[key].n_a + rows[key].n_b - rows[key].n_groups
        sides = [group.split("|") for group in rows[key].groups.split(";")]
        assert [int(i) for a, _ in sides for i in a.split(",")] == v.a.encode(" " + text).ids
        assert [int(i) for _, b in sides for i in b.split(",")] == v.b.encode(text)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert aligned_documents(docs, PATHS).collect() == []
    assert aligned_documents(docs, PATHS, broadcast_bytes=-1).collect() == []


def test_counts_do_not_depend_on_the_tree(spark):
    """Many leaves, few leaves: the same pairs, counts and best marks."""
    docs = spark.createDataFrame(
        [(i, text) for i, text in enumerate(random_texts(400, seed=3))], "key long, text string"
    ).repartition(24)
    tables = []
    for tasks_of_leaf in (1, 1000):
        found = {}
        for r in pair_counts(docs, PATHS, tasks_of_leaf).collect():
            pairs, counts = np.frombuffer(r.pairs, "<u4"), np.frombuffer(r.counts, "<i8")
            bits = np.unpackbits(np.frombuffer(r.best, np.uint8), count=len(pairs))
            found |= dict(zip(pairs.tolist(), zip(counts.tolist(), bits.tolist())))
        tables.append(found)
    assert tables[0] == tables[1]
    plain = Plain()
    want = Counter((i << 16) | j for row in docs.collect() for i, j in plain.links(row.text))
    assert {p: n for p, (n, _) in tables[0].items()} == want


def test_sums_of_nothing():
    pairs, counts = summed(np.zeros(0, "<u4"), np.zeros(0, np.int64))
    assert len(pairs) == len(counts) == 0


def test_query(spark):
    """The registered query over the whole smallest table."""
    sf_dir = "/root/testdata/sf0.001"
    found = op12_token_alignment(spark, sf_dir).select(*NAMES).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    by_id = {row.doc_id: row for row in found}
    v = Vocabularies(*PATHS)
    for row in docs:
        assert by_id[row.doc_id].n_a == len(v.a.encode(" " + row.text).ids)
        assert by_id[row.doc_id].n_b == len(v.b.encode(row.text))
    few = [(r.doc_id, r.text) for r in docs if len(r.text) < 800]
    want = {row[0]: row for row in brute_force(few)}
    for key, row in want.items():
        assert (by_id[key].n_groups, by_id[key].groups_sha256) == (row[3], row[7])

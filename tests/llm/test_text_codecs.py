"""Token counts, token store and the SentencePiece codec against the public libraries."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratelake.llm.key_index import build, slots_of
from ratelake.llm.piece_codec import MergeEncoder, encode_decode, encode_decode_digests, encoder
from ratelake.llm.rows import Recent, map_batches
from ratelake.llm.token_counts import PairMerger, token_counts
from ratelake.llm import token_store
from ratelake.llm.queries import indexed_digests
from ratelake.llm.token_store import lookup, lookup_rows, read_ids, shard_starts, stored_digests, write_store
from ratelake.llm.word_ids import WordEncoder
from ratelake.sources.shared import shared_folder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

PARTS = [" ", "  ", "\n", "\t", "a", "the", "'s", "é", "日本", "1", "23", "!", "...", "I'm", "ſ"]
PARTS += ["<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x85", "\r\n", "'S", "🙂", "é", "\x00"]
PARTS += ["▁", "<s>", "<0x41>", "İ", "ß", "Σ", "̈", "<", "̸", "tion", "aaaa", "\x01", "The"]

#: Nulls, empty and very long texts, repeated rows, and columns whose names clash with ours.
ROWS = [
    (1, None, 0, "x"),
    (2, "", 0, None),
    (None, "a null key", 0, "x"),
    (3, "the same row", 1, "x"),
    (3, "the same row", 1, "x"),
    (3, "the same key, another text", 1, "x"),
    (4, "word, " * 30000, 2, "x"),
    (5, "ab" * 60000, 2, "x"),
    (0, "last! <|endoftext|> naïve façade 日本 ퟿", 2, "x"),
]
SCHEMA = "doc_id long, text string, n_tokens int, key string"


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_counts_equal_the_library():
    merger, library = PairMerger(BYTES, cached=50), Tokenizer.from_file(BYTES)
    for text in random_texts(3000):
        assert merger.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_counts_of_any_row(docs):
    library = Tokenizer.from_file(BYTES)
    got = token_counts(docs, BYTES).collect()
    want = [
        (k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        for k, t, _, _ in ROWS
    ]
    key = lambda row: tuple(map(str, row))
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts(docs.limit(0), BYTES).count() == 0


def test_word_ids_equal_the_library():
    encoder, library = WordEncoder(WORDS, cached=50), Tokenizer.from_file(WORDS)
    for text in random_texts(3000, 2):
        got = np.frombuffer(encoder.encode(text), encoder.kind).tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


#: Characters that change before a sign: composed letters that NFC takes apart, letters whose
#: lower case ends in a mark, marks, and controls that are white space to some only.
CHANGING = [chr(c) for c in range(0x958, 0x960)] + ["İ", "\ufb2e", "\ufb1d", "ड़", "é", "ﬁ", "ß"]
CHANGING += ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u0301", "\u0307", "½", "²", "٣", "ª", "º", "µ"]


def test_word_ids_before_signs_equal_the_library():
    encoder, library = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [f"al{c}{sign} b{sign} {c}{sign} x" for c in CHANGING + PARTS for sign in ",."]
    texts += ["ALİ, b", "पहाड़, b. पढ़. ", ", b", ". , .", "a_, b", "a), b", "१, २. ३"]
    rng = random.Random(4)
    pieces = CHANGING + PARTS + [", ", ". ", ", ", ". ", "word", "Ünïcode", "9"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(20000)]
    for text in texts:
        got = np.frombuffer(encoder.encode(text), encoder.kind).tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


def test_the_result_comes_through_the_index(spark, docs):
    """All rows of all keys are found; an index with other places gives another result."""
    path = shared_folder(spark, "store")
    write_store(docs, path, WORDS)
    got = indexed_digests(spark, path, docs).collect()
    assert len(got) == len(ROWS)
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == np.cumsum([0] + [n for _, n in starts])[:-1].tolist()
    assert sorted(r.nth for r in lookup_rows(spark, path, docs.where("doc_id = 3")).collect()) == [0, 1, 2]
    wrong = shared_folder(spark, "store")
    spark.read.parquet(f"{path}/ids").write.parquet(f"{wrong}/ids")

    def moved(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            entries = [np.frombuffer(x.as_py(), token_store._ENTRY).copy() for x in columns["entries"]]
            for entry in entries:
                entry["place"] += 1
            columns["entries"] = pa.array([x.tobytes() for x in entries], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    index = spark.read.parquet(f"{path}/index")
    index.mapInArrow(moved, index.schema).write.parquet(f"{wrong}/index")
    other = indexed_digests(spark, wrong, docs).collect()
    assert len(other) < len(got) and not {(r.doc_id, r.start) for r in got} & {
        (r.doc_id, r.start) for r in other
    }


def test_many_rows_of_a_key_over_shards(spark, monkeypatch):
    """A third of the rows share a key; each has its own place."""
    docs = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 7, id) as doc_id", "concat('text ', id % 11) as text"
    )
    path = shared_folder(spark, "store")
    write_store(docs, path, WORDS)
    got = indexed_digests(spark, path, docs).collect()
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert len(starts) == 3000 == len(set(starts))
    assert [s for s, _ in starts] == np.cumsum([0] + [n for _, n in starts])[:-1].tolist()
    assert {r.rows_of_key for r in got} == {1, 1001}


def test_store_round_trip(spark, docs):
    library = Tokenizer.from_file(WORDS)
    path = shared_folder(spark, "store")
    write_store(docs, path, WORDS)
    coded = [
        (k, library.encode(t or "", add_special_tokens=False).ids + [1]) for k, t, _, _ in ROWS
    ]
    got = stored_digests(spark, path).join(shard_starts(spark, path), "shard").collect()
    got = sorted(got, key=lambda r: r.base + r.offset)
    assert [r.doc_id for r in got] == sorted((k for k, _ in coded), key=lambda k: (k is not None, k or 0))
    start = 0
    for row in got:
        assert row.base + row.offset == start
        start += row.n_tokens
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (str(k), len(ids), crc(ids)) for k, ids in coded
    )
    asked = spark.createDataFrame([(1,), (3,), (4,), (99,), (None,), (3,)], "doc_id long")
    found = {r.doc_id: r for r in lookup(spark, path, asked).collect()}
    assert set(found) == {1, 3, 4, None} and found[3].rows == 3 and found[4].rows == 1
    ids = {r.doc_id: r.ids for r in read_ids(spark, path, asked.where("doc_id <> 3")).collect()}
    assert ids == {k: v for k, v in coded if k in (1, 4)}


def test_empty_store(spark, docs):
    path = shared_folder(spark, "store")
    write_store(docs.limit(0), path, WORDS)
    assert stored_digests(spark, path).count() == 0
    assert lookup(spark, path, docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
    index, slots = build(a, b)
    assert sorted(slots.tolist()) == list(range(n))
    assert slots_of(index, a, b).tolist() == slots.tolist()


def test_pieces_equal_the_library():
    codec = MergeEncoder(PIECES, cached=50)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in random_texts(3000, 3):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text), text
    for text in ("the quick" * 3000, "x" * 9000, "日本" * 5000):  # beyond a block
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text)


def test_blanks_and_their_sign_encode_alike():
    codec = MergeEncoder(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ("a▁b c", "▁a", " ▁ a", "a  ▁", "▁▁", "é ▁\x01 b", "a▁▁b  c"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text), text
    # What is remembered is plain: a sign of a blank would double the size of each part.
    assert all(part.isascii() for part in codec.parts if "é" not in part)


def test_memory_keeps_what_is_frequent_and_stays_bounded():
    asked = []
    memory = Recent(lambda w: asked.append(w) or w.upper(), 20)
    for i in range(300):
        assert memory[f"w{i}"] == f"W{i}" and memory["often"] == "OFTEN"
        assert len(memory) + len(memory.before) <= 20
    assert asked.count("often") == 1 and len(asked) == 301


def test_a_worker_keeps_one_operators_memories():
    """A pipeline's stages run in the same workers, one after the other."""

    class Worker:
        def mapInArrow(self, task, schema):
            return list(task(iter([])))

    def held(batches):
        yield encoder.cache_info().currsize

    encoder.cache_clear()
    encoder(PIECES)
    assert map_batches(Worker(), held, "n long", "ratelake.llm.piece_codec") == [1]
    assert map_batches(Worker(), held, "n long") == [0]


def test_codec_of_any_row(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    whole = {(r.doc_id, r.decoded): r.ids for r in encode_decode(docs, PIECES).collect()}
    for k, t, _, _ in ROWS:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(whole[k, library.decode(ids)], "<u4").tolist() == ids
    digests = encode_decode_digests(docs, PIECES).where("doc_id = 2").first()
    assert digests.n_tokens == 2 and digests.decoded_sha256 == sha256(b"").hexdigest()
    assert encode_decode(docs.limit(0), PIECES).count() == 0
    assert encode_decode(docs, PIECES).where(F.col("doc_id").isNull()).count() == 1

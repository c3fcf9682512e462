"""Every registered query on odd tables and on empty ones, against its contract's columns."""

import zlib
from collections import Counter
from hashlib import sha256

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
from ratelake.llm.queries import registered
from ratelake.sources.shared import shared_folder
from tests.llm.test_text_codecs import BYTES, PIECES, WORDS

PASSAGE = "a passage that several of these documents share, long enough to be found again " * 4
TEXTS = {
    1: None,
    2: "",
    3: "the house by the river and the garden of the king, and the road to the old town",
    4: "the house by the river and the garden of the king, and the road to the old town",
    5: "Das Haus am Fluss und der Garten des Königs, und die Straße in die alte Stadt",
    6: f"first {PASSAGE} then something else",
    7: f"second {PASSAGE} then another thing",
    8: "½ ² ① <|endoftext|> <s> ▁ ALİ, b. पहाड़, x \x1c, y 日本語",
    9: "word, " * 20000,
    10: "ab" * 40000,
    11: "#### $$$$ %%%% **** &&&&\n" * 30,
    12: "\n\n \t ",
}
#: Columns of the contract, with what each row must have; None: any value.
COLUMNS = {
    "op1_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op4_token_store": "doc_id start n_tokens ids_crc32",
    "op6_simhash_near_duplicates": "doc_id fingerprint component_id",
    "op7_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op8_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9_sentencepiece_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_language_id": "doc_id held_out lang_pred score",
    "op11_attention_quality": "doc_id held_out score predicted",
    "op12_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
}


@pytest.fixture(scope="module")
def tables(spark):
    """A folder with odd tables and one with empty ones: more columns, names that clash."""
    rows = [(k, t, [None, "en", "de", "fr"][k % 4], f"s{k % 3}", len(t or "")) for k, t in TEXTS.items()]
    rows += [(None, "a null key", "en", None, None), (3, TEXTS[3], "en", "s0", 81), (3, "another text", "en", "s0", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["key", "row", "tie", "mark", "position", "tree", "label", "score", "a", "hash", "n_tokens"]
    docs = docs.withColumns({name: F.lit(name) for name in clash})
    others = {
        "benchmark": spark.createDataFrame(
            [(1, TEXTS[3]), (2, None), (3, ""), (None, "a passage that several of these documents share")],
            "item_id long, text string",
        ),
        "labels": spark.createDataFrame(
            [(k, k % 2, 0) for k in (1, 2, 3, 3, 5, 6, 9, 99)] + [(None, 1, 0), (7, None, None)],
            "doc_id long, quality int, toxic int",
        ),
        "pages": spark.createDataFrame(
            [(1, "http://a.example.com/x", ""), (2, None, None), (3, "no address", ""), (3, "", "")],
            "page_id long, url string, html string",
        ),
    }
    odd, empty = shared_folder(spark, "odd"), shared_folder(spark, "empty")
    for name, table in {"documents": docs, **others}.items():
        table.write.parquet(f"{odd}/{name}.parquet")
        table.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return odd, empty, docs.select("doc_id", "text").collect()


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_on_odd_and_empty_tables(spark, tables, name):
    odd, empty, docs = tables
    found = contract.queries()[name](spark, odd)
    rows = found.collect()
    assert contract.queries()[name](spark, empty).collect() == []
    if name not in COLUMNS:
        return
    assert set(COLUMNS[name].split()) <= set(found.columns)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs)


def by_id(rows):
    """Rows of the documents whose id is no one else's."""
    return {r.doc_id: r for r in rows if r.doc_id not in (None, 3)}


def test_lengths_and_digests(spark, tables):
    """What the contract fixes without the method: lengths, checksums, held-out rows."""
    odd, _, docs = tables
    queries = contract.queries()
    texts = {r.doc_id: r.text or "" for r in docs if r.doc_id not in (None, 3)}
    tokens, words = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts, store = by_id(queries["op1_token_counts"](spark, odd).collect()), queries["op4_token_store"](spark, odd)
    store, codec = store.collect(), by_id(queries["op9_sentencepiece_codec"](spark, odd).collect())
    cut = by_id(queries["op7_suffix_array_dedup"](spark, odd).collect())
    for key, text in texts.items():
        assert counts[key].n_bytes == len(text.encode()) == cut[key].n_bytes
        assert counts[key].n_tokens == len(tokens.encode(text, add_special_tokens=False).ids)
        ids = pieces.encode(text, add_bos=True, add_eos=True)
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (codec[key].n_tokens, codec[key].ids_sha256) == (len(ids), sha256(data).hexdigest())
        assert codec[key].decoded_sha256 == sha256(pieces.decode(ids).encode()).hexdigest()
        ids = words.encode(text, add_special_tokens=False).ids + [1]
        (row,) = (r for r in store if r.doc_id == key)
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(data))
    start = 0
    for row in sorted(store, key=lambda r: r.start):
        assert row.start == start
        start += row.n_tokens


def removed(texts, length=200):
    """Brute force: the bytes that a string covers that starts anywhere else."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        out.append(gone)
    return out


def test_repeats_against_brute_force(spark, tables):
    odd, _, docs = tables
    texts = [(r.text or "").encode() for r in docs]
    want = Counter()
    for row, text, gone in zip(docs, texts, removed(texts), strict=True):
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not h for g, h in zip(gone, b"\x00" + gone))
        want[(row.doc_id, len(text), sum(gone), spans, sha256(kept).hexdigest())] += 1
    names = COLUMNS["op7_suffix_array_dedup"].split()
    got = contract.queries()["op7_suffix_array_dedup"](spark, odd).select(*names).collect()
    assert Counter(tuple(r) for r in got) == want


def test_languages_and_quality_of_odd_texts(spark, tables):
    odd, _, docs = tables
    texts = {r.doc_id: r.text or "" for r in docs if r.doc_id not in (None, 3)}
    language = by_id(contract.queries()["op10_language_id"](spark, odd).collect())
    quality = by_id(contract.queries()["op11_attention_quality"](spark, odd).collect())
    for key, text in texts.items():
        crc = zlib.crc32(str(key).encode())
        assert language[key].held_out == (crc % 5 == 0) and quality[key].held_out == (crc % 4 == 2)
        assert 0 <= language[key].score <= 1 and 0 <= quality[key].score <= 1
        assert quality[key].predicted == (quality[key].score >= 0.7)
        if not any(c.isalpha() for c in text):
            assert language[key].lang_pred == "und"

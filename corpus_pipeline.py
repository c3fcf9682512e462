"""The document pipeline: each stage works on all that the stage before it kept.

Stages take (spark, docs, sf_dir) and return the columns of documents, but for the last,
which returns what the texts become. Between stages rows are written as Parquet to the
shared folder and read again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelake.llm.decontamination import contaminated
from ratelake.llm.language_id import in_holdout, language_spans, learn
from ratelake.llm.piece_codec import encode_decode_digests
from ratelake.llm.repeats import remove_repeats
from ratelake.llm.rows import staged_rows, table
from ratelake.llm.simhash import near_duplicates
from ratelake.sources.shared import remove_folders, tracking

#: Share of a document's letters, weighed with the evidence, below which it is rejected. Half
#: the share counts if the prevailing language is not that of the evidence as a whole, so a
#: text whose languages are several stays.
LEAST_LANGUAGE_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty texts among them), or without a
    language that prevails.

    The model is learnt from the labelled documents of the input itself, hold-out aside. A
    missing label takes the prediction. Texts of any length are read whole; equal rows are
    judged each; an empty table gives an empty one; other columns, of any name, stay.
    """
    model = learn(docs.where(~in_holdout("doc_id")))
    others = [name for name in docs.columns if name != "text"]
    rows = docs.select(F.struct(*map(_column, others)).alias("row"), F.col("text"))
    found = language_spans(rows, model, key="row", with_text=True)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    named = {"text": F.col("text"), "lang": F.coalesce("row.lang", "lang_pred").alias("lang")}
    return kept.select(*(named.get(c, F.col(f"row.`{c}`")) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the smallest id, null ids last; of rows with equal
    id and text the one whose other columns, as JSON, come first.

    Null and empty texts are one group. Texts of any length are read whole; an empty table
    gives an empty one; other columns, of any name and type, stay.
    """
    found = near_duplicates(docs.select("doc_id", "text")).where("chosen")
    chosen = found.select(F.col("doc_id").alias("id"), F.col("tie").alias("same")).distinct()
    others = F.struct(*(_column(name) for name in docs.columns if name != "text"))
    rows = docs.select(
        F.struct(*map(_column, docs.columns)).alias("row"),
        F.col("doc_id").alias("key"),
        F.xxhash64("text").alias("tie"),
        F.to_json(others, {"ignoreNullFields": "false"}).alias("order"),
    )
    same = F.col("key").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("same"))
    kept = rows.join(chosen, same, "left_semi").groupBy("key", "tie")
    return kept.agg(F.min_by("row", "order").alias("row")).select(*_fields(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings that occur twice; a document of which nothing is left goes.

    A character that a cut would split goes as a whole, and n_chars follows the text. A
    null text is empty and stays so, with the others that lose nothing; equal texts of 200
    bytes and more lose everything. Texts of any length are read whole; an empty table
    gives an empty one; other columns, of any name and type, stay.
    """
    others = [name for name in docs.columns if name != "text"]
    rows = docs.select(F.struct(*map(_column, others)).alias("row"), F.col("text"))
    found = remove_repeats(rows, key="row", text="text", whole_characters=True)
    cut = found.where("n_removed = 0 or n_removed < n_bytes")
    cut = cut.select("row", F.col("kept").cast("string").alias("text"))
    named = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        named["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select(*(named.get(c, F.col(f"row.`{c}`")) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a test item, an edited one included.

    Null and empty texts hold none; texts of any length are searched whole; equal rows go
    or stay together; an empty table gives an empty one; other columns stay.
    """
    mark = F.xxhash64("doc_id", "text", F.lit(5))
    rows = docs.select(
        F.struct(*map(_column, docs.columns)).alias("row"), mark.alias("mark"), F.col("text")
    )
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), key="mark")
    hit = staged_rows(found.select("mark").distinct(), "contaminated")
    return rows.join(hit, "mark", "left_anti").select(*_fields(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes the texts that are left; ids and texts as digests.

    Null and empty texts have the end ids alone; texts of any length are coded whole; equal
    rows are coded each; an empty table gives no rows; other columns are not read.
    """
    return encode_decode_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def _fields(docs: DataFrame) -> list[Column]:
    """The columns of docs, out of a column ``row`` that carries them."""
    return [F.col(f"row.`{name}`") for name in docs.columns]


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("sentencepiece_codec", encode_pieces),
]

#: The stages encode, hash and align texts; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each on what the one before it wrote.

    A stage's folders are removed once the next one is written; the last one's stays.
    """
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with tracking() as folders:
            docs = staged_rows(stage(spark, docs, sf_dir), name)
        # The stage's result is the last folder that it named.
        remove_folders(spark, done + folders[:-1])
        done = folders[-1:]
    return docs

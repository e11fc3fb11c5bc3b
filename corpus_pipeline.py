"""The corpus pipeline: language ID, line dedup, near-duplicate removal and packing, each stage over what the last kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.language import fit, identify
from lamina.llm.lines import drop_common_lines
from lamina.llm.near import near_duplicates
from lamina.llm.packing import pack
from lamina.llm.shared import stored

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the centroids know; those rejected, or without letters, go.

    Defined cases: null, empty and letterless texts go; without a labelled text there are no centroids and all documents
    go; repeated rows and ids, and null ids, are judged each by its text; other columns are dropped; an empty table
    stays empty.
    """
    known = identify(docs.select(*COLUMNS), fit(docs))
    return known.where(~F.col("rejected")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go; every document stays, and n_chars follows its text.

    Defined cases: a null text becomes empty; a document all of whose lines go stays with an empty text; repeated rows
    count as documents each; null ids stay; other columns are dropped; an empty table stays empty.
    """
    out = drop_common_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (similarity 0.8 or more), that with the smallest id, stays.

    Where ids are null or repeated they cannot tell rows apart: rows then get numbers in the order of ids, nulls last.
    Defined cases: texts without words, null ones among them, have no copies and stay; equal rows are copies, of which
    one stays; of rows that tie in id any one stays; other columns are dropped; an empty table stays empty.
    """
    docs, key = docs.select(*COLUMNS), "doc_id"
    if not docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        key, order = "row", [F.asc_nulls_last("doc_id"), F.md5("text"), "place"]  # the last two only spread equal ids
        ordered = docs.withColumn("place", F.monotonically_increasing_id()).orderBy(*order)
        docs = stored(ordered.withColumn(key, F.monotonically_increasing_id()), "numbered")
    gone = stored(near_duplicates(docs, percent=80, id_col=key).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(gone, key, "left_anti").select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens.

    Defined cases: a null or empty text is its end token alone; null ids and repeated rows are packed each; a text longer
    than a window is cut; an empty table gives no rows.
    """
    return pack(docs, WORD_TOKENIZER)


STAGES = [("language", keep_languages), ("lines", drop_lines), ("near_duplicates", drop_near_duplicates), ("packing", pack_windows)]

#: SQL cannot express centroids and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

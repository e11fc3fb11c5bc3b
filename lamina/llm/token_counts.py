"""Token counts from a digest cache: only distinct texts that the cache lacks are encoded, then appended to it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Sink, bounded, rows, scratch, stored
from .wordbpe import word_bpe

COUNTS = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
STORED = "digest binary, n_tokens long"


def version_digest(tokenizer: str) -> str:
    """Names the tokenizer by its file's bytes and its library's version."""
    import sentencepiece
    import tokenizers

    library = tokenizers if tokenizer.endswith(".json") else sentencepiece
    with open(tokenizer, "rb") as f:
        return hashlib.sha256(f.read() + f"\n{library.__name__} {library.__version__}".encode()).hexdigest()[:32]


def encode_counts(misses: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, text) to (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer.endswith(".json"):
            ids = word_bpe(tokenizer).encode
            count = lambda text: len(ids(text)) // 4
        else:
            from .pieces import piece_encoder

            encode = piece_encoder(tokenizer).ids
            count = lambda text: len(encode(text)) // 4
        sink = Sink(COUNTS)
        for digest, text in rows(batches):
            if sink.add(digest, count(text)):
                yield sink.batch()
        if sink.n:
            yield sink.batch()

    return bounded(misses).mapInArrow(run, STORED)


def _cache(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(STORED).parquet(path)


def count_tokens(docs: DataFrame, tokenizer: str, *, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    cache: a folder that only grows, one subfolder per tokenizer version; None: a new one in the shared folder. Writers that
    work at the same time may both add a digest, which then counts once. Content is keyed by the SHA-256 digest of its normal form (null is empty; for a tokenizer that
    drops outer blanks these are dropped). Each distinct text that the cache lacks is encoded once, however many copies
    there are: copies are merged before the shuffle, and the join that brings counts back can be split at hot digests.

    Defined cases: null or empty text has 0 bytes and the tokenizer's count for "" ; null ids and repeated rows stay;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = f"{cache or scratch(spark, 'token-counts')}/{version_digest(tokenizer)}"
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    content = F.trim(text) if tokenizer.endswith(".json") and word_bpe(tokenizer).fast else text
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("text"))
    known, wanted = _cache(spark, path), keyed
    if known is not None:  # digests alone meet the cache; only misses move their texts
        missed = keyed.select("digest").distinct().join(known, "digest", "left_anti")
        wanted = keyed.join(missed, "digest", "left_semi")
    misses = wanted.groupBy("digest").agg(F.first("text").alias("text"))
    encode_counts(misses.select("digest", "text"), tokenizer).write.mode("append").parquet(path)
    counts = spark.read.schema(STORED).parquet(path)
    if cache:  # Two writers may have added the same digest: it counts once. Written, so that the join can be split.
        counts = stored(counts.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "counts")
    out = keyed.select("doc_id", "n_bytes", "digest").join(counts, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

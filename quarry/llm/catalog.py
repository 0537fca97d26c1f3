"""Queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (
    backoff,
    chat,
    decontam,
    interleave,
    itq,
    langid,
    manifest,
    partenum,
    pieces,
    quality,
    secrets,
    sparse_suffix,
    vectors,
)
from quarry.llm.common import hash_fold, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards that each hold every source in proportion."""
    return interleave.interleave(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source", "rank")


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item whose alignment reaches half the item's own score."""
    return decontam.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op6_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return partenum.jaccard_components(read_table(spark, sf_dir, "documents"))


@query
def op3_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document that passages of 50 words or more, found in another document, cover."""
    return sparse_suffix.passages(read_table(spark, sf_dir, "documents"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from four fifths of the labelled ones."""
    docs = read_table(spark, sf_dir, "documents")
    machine = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, machine).select(
        "doc_id", (hash_fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from two thirds of the labelled ones."""
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select(
        "doc_id", (hash_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: spans of the fixed patterns and of the Markov models."""
    docs = read_table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


@query
def op4_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff log score of every document under the trigram counts of all others."""
    return backoff.scores(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.col("n_2").alias("n_bigrams"), F.col("n_3").alias("n_trigrams"), F.round("log_score", 4).alias("log_score"),
        F.round("mean_log", 6).alias("mean_log"))


@query
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, and whether decoding gives its text back."""
    return pieces.encode(read_table(spark, sf_dir, "documents"))


@query
def op1_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of each label (cosine 0.98 or more): links, component, and the one kept."""
    return itq.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code of every vector and its error, after six rounds of the codebooks."""
    codes, books = vectors.compress(read_table(spark, sf_dir, "embeddings"))
    return vectors.with_label_error(codes).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(None if books is None else vectors.books_digest(books)).cast("string").alias("codebooks_sha256"))


@query
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted with its loss mask: counts and digests of what is read back."""
    return chat.digests(chat.format_chats(chat.with_probe(read_table(spark, sf_dir, "conversations"))))


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the Merkle manifest: digests, proof, and the root that a tampered text folds to."""
    return manifest.proofs(manifest.manifest(read_table(spark, sf_dir, "documents")))

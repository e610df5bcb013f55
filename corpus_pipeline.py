"""From raw documents to token ids, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next one's docs. All stages read whole texts of any
length, keep the columns of docs (whatever their names; the operators' own are
named apart), and give an empty result for an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelens.llm._common import Scratch, growing, prefix, read_table
from wavelens.llm.bpe_codec import encode_decode
from wavelens.llm.exact_dedup import deduplicated
from wavelens.llm.minhash import near_duplicates
from wavelens.llm.mixing import training_order
from wavelens.llm.quality import classify


def _kept(docs: DataFrame, judged: DataFrame, text_hash: str | None = None) -> DataFrame:
    """The rows of docs that an operator keeps: by doc_id and, where it judges
    rows of an id apart, by the hash of their text."""
    p = prefix(docs)
    names = {"doc_id": f"{p}id"} | ({text_hash: f"{p}hash"} if text_hash else {})
    kept = judged.where("kept").select(*(F.col(c).alias(n) for c, n in names.items())).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{p}id"))
    if text_hash:
        same = same & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(f"{p}hash"))
    return docs.join(growing(kept), same, "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts go.
    Rows that repeat an id are judged one by one, equal rows alike; a null lang is
    a language of its own; rows without an id are judged by the others' model."""
    return _kept(docs, classify(spark, docs, read_table(spark, sf_dir, "labels")), "text_hash")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space:
    the longest, then that of the smallest id (null last), then the first by a
    hash of all columns. Null, empty and blank texts are one group."""
    return deduplicated(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates. Rows of
    one id are one document, which stays or goes as a whole; rows without an id
    and texts without a word link to none and stay."""
    return _kept(docs, near_duplicates(spark, docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of whole documents by the sources' target weights, in training
    order. A null source is one of its own; texts without a word are not taken;
    equal rows are copies of their own; ties go by id, then by text."""
    return training_order(spark, docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and digests of the ids and of what they decode
    to. A null text counts as empty and has no ids; a row gives a row."""
    return encode_decode(spark, docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mixed), ("bpe", encoded)]

#: The quality model and the encoder have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs

"""A training corpus from `documents`: language, repeated lines, near duplicates, benchmark passages, packed sequences.

Each stage works on all that its predecessor kept. A stage returns the columns of documents, but for the last, which returns the
packed pieces. Stages are written as Parquet to the shared folder and read again, so a lost executor costs no earlier stage.

Defined results: rows with a null text, without a letter, or mostly in scripts of no learned language are rejected by the first stage, which
writes the language it finds where lang is null; repeated rows count as copies, of which one stays; rows with one doc_id and different texts, and
rows with a null doc_id, are documents each, told apart by their texts; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import decontaminate, language, line_templates, minhash, packing
from ledgerlark.llm._common import discarded, read_table, recorded, stored, text_key

#: Documents with a smaller share of their letters in scripts of learned languages are rejected.
READABLE = 0.5


#: Tables that the stage before stored for itself; its result is written when the next begins. By thread, as each runs one pipeline at a time.
_before = threading.local()


def _stage(function):
    """A stage that first removes what the one before, whose result is written by now, stored for itself."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discarded(spark, getattr(_before, "paths", []))
        with recorded() as _before.paths:
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang is filled in where it is null."""
    found = language.identified(docs, language.train(docs)).filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("readable") >= READABLE))
    return found.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates, and none of which nothing else is left; n_chars follows the text."""
    found = line_templates.dedup_lines(docs, by_groups=True).filter("n_dropped = 0 OR text RLIKE '[^ \\\\s]'")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near duplicates."""
    first = minhash.near_duplicates(docs).filter("first").select(F.struct("doc_id", "text_key").alias("_id"))
    rows = docs.withColumn("_id", F.struct("doc_id", text_key().alias("text_key")))
    return rows.join(first, "_id", "left_semi").dropDuplicates(["_id"]).select(*docs.columns)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span of words with a benchmark item."""
    found = decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    hit = found.filter("contaminated").select(F.col("text_key").alias("_key")).distinct()
    return docs.withColumn("_key", text_key()).join(hit, "_key", "left_anti").select(*docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: The language model, the estimates of similarity and the tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return docs

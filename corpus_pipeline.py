"""A training corpus from ``documents``: identify languages, drop copies, mix the sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each as Parquet and reads it again.
All stages but the last return the columns of ``documents``, whatever they are. Repeated rows count as rows of their
own, and an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import bpe, exact_dedup, language_id, minhash_dedup, mixing
from mnemospark.llm.common import read_table, shared_dir
from mnemospark.sources.scratch import drop_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go; ``lang`` becomes the language that the parse finds."""
    return language_id.keep_identified(docs, read_table(spark, sf_dir, "documents"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the longest; rows that repeat its doc_id stay with it."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; so do texts without words and rows without doc_id."""
    return minhash_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row comes once per pass that draws from it, with the words drawn; n_chars is brought up to date."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row: doc_id (null if it was), n_tokens, ids; a null or empty text has none. They are decoded
    and must give the row's text again."""
    return bpe.encode_documents(docs, decoded=False)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact),
    ("minhash_dedup", drop_near),
    ("mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: No SQL: language identification, the multinomial draws and BPE have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; a stage's table goes when the next has been written, the last when the application ends."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    drop_folder(spark, base, at_exit=True)
    before = None
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return docs
